"""The corpus operators against plain Python on small inputs with nulls, blanks, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harness import duck, rows_of
from poolcall.llm import queries
from poolcall.llm.components import components
from poolcall.llm.language import Model, held_out, identify_held_out, letter_words
from poolcall.llm.line_quality import base_counts, decode, line_quality
from poolcall.llm.mixing import budgets, mix
from poolcall.llm.neighbours import chi_square, nearest
from poolcall.llm.packing import pack, pack_documents
from poolcall.llm.simhash import block_masks, fingerprint, linked_groups, near_duplicates, near_links, one_of_each, signed
from poolcall.llm.substrings import dedup_substrings
from poolcall.llm.tokens import Counting, count_tokens, read_vocabulary
from poolcall.llm.tool_calls import link_tool_calls, order_calls
from poolcall.llm.weak_quality import fit_labellers, pattern, weak_quality

SF = "/root/testdata/sf0.001"
DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, key int, seq int"


def words(rng, n, kinds=40):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, blanks, repeats, shared passages and a very long text; columns with clashing names."""
    rng = random.Random(5)
    passage = words(rng, 60, 10_000)
    texts = [None, "", " \n\t ", "one", passage, "before it " + passage + " after it", passage, words(rng, 300, 5000),
             words(rng, 25) + "\n" + passage[:200] + " end", "Ä" * 30 + " ß", "x " * 40, words(rng, 30_000, 900), passage + " " + passage]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k else None, None, "x", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[4], (None, passage, None, None, None, None, None, None)], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def removed_plainly(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone[s:s + 20] = b"\1" * 20
            seen.add(k)
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def test_substrings(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").distinct().collect()]
    got = dedup_substrings(odd, carry=("lang",)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256), "removed").collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == removed_plainly(rows)
    assert all(r["n_removed"] == sum(s["stop"] - s["start"] for s in r["removed"]) for r in got)
    assert len(got) == odd.filter("doc_id IS NOT NULL").count() and dedup_substrings(empty).count() == 0
    with pytest.raises(ValueError):
        dedup_substrings(odd, cover=(0, 1))


def test_substring_query(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_substrings(spark, SF).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == removed_plainly(rows)


def reach_plainly(prints, distance=3):
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= distance) for i in range(len(prints))]
        if new == label:
            return label
        label = new


def test_simhash(spark, odd, empty):
    got = near_duplicates(odd).collect()
    rows = sorted({(r["doc_id"], r["text"]) for r in odd.filter("doc_id IS NOT NULL").collect()}, key=lambda r: r[0])
    prints = [fingerprint(t) for _, t in rows]
    want = {i: (signed(p), rows[k][0]) for (i, _), p, k in zip(rows, prints, reach_plainly(prints))}
    assert {r["doc_id"]: (r["fp"], r["component_id"]) for r in got} == want
    assert len(got) == odd.filter("doc_id IS NOT NULL").count() and near_duplicates(empty).count() == 0
    assert one_of_each(odd).filter("doc_id IN (5, 6)").count() <= 1


def test_simhash_query(spark):
    rows = sorted((r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [fingerprint(t) for _, t in rows]
    want = {i: (f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, reach_plainly(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash(spark, SF).collect()} == want


def test_blocks_meet_and_large_buckets_agree(spark):
    rng = random.Random(1)
    masks = block_masks(3)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << k for k in rng.sample(range(64), 3))
        assert any(a & m == b & m for m in (m & (1 << 64) - 1 for m in masks))
    near = sorted({signed((0xABCDEF0123456789 ^ sum(1 << k for k in rng.sample(range(20), rng.randrange(5)))) & (1 << 64) - 1) for _ in range(150)})
    nodes = spark.createDataFrame([(x,) for x in near], "fp bigint")
    roots = [near[k] for k in linked_groups(np.array(near).view(np.uint64), 3)]
    for bucket in (8, 4096):
        got = {r["node"]: r["root"] for r in components(near_links(nodes, 3, bucket)).collect()}
        assert [got.get(x, x) for x in near] == roots


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_tokens_equal_the_tokenizer(spark, odd):
    from tokenizers import Tokenizer, models, pre_tokenizers
    rng = random.Random(2)
    for _ in range(300):
        voc = list({"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))): -float(rng.randint(0, 4)) for _ in range(rng.randint(1, 12))}.items())
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 12)))
        for fallback in (True, False):
            bytes_ = [(f"<0x{b:02X}>", min(s for _, s in voc)) for b in range(256)] if fallback else []
            plain = Tokenizer(models.Unigram([("<unk>", 0.0), *voc, *bytes_], 0, fallback))
            plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
            assert Counting(voc, fallback).text(text)[0] == len(plain.encode(text, add_special_tokens=False).ids), (voc, text)
    got = count_tokens(odd, read_vocabulary()).collect()
    assert len(got) == odd.count() and {r["n_tokens"] for r in got if r["doc_id"] in (0, 1)} == {0}


def test_base_counts_and_verdict(spark, odd, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert base_counts("a b#\n\na b#\n" + "p q r s t " * 2) == (14, 16, 2, 1, 10)
    got = {r["doc_id"]: r for r in line_quality(odd, labels).collect() if r["doc_id"] is not None}
    assert got[0]["base_failed"] and not got[0]["kept"] and got[0]["n_words"] == 0 and got[10]["base_failed"]
    assert line_quality(empty, labels).count() == 0
    unlabelled = line_quality(odd, labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in unlabelled if r["n_words"])


def test_quality_on_labelled_rows(spark):
    for found, keep in ((queries.op3_line_quality(spark, "/root/testdata/sf0.01"), "kept"), (queries.op1_weak_quality(spark, "/root/testdata/sf0.01"), "good")):
        both = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
        if keep == "kept":
            both = both.filter("n_words >= 10")
        n = {(r["quality"], r[keep]): r["count"] for r in both.groupBy("quality", keep).count().collect()}
        assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
        assert n.get((0, False), 0) >= 0.9 * (n.get((0, True), 0) + n.get((0, False), 0))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(50):
        s, t = rng.normal(size=6), rng.normal(size=(2, 2))
        value = lambda y: sum(s[k] * y[k] for k in range(6)) + sum(t[y[k], y[k + 1]] for k in range(5))
        best = max(([b >> k & 1 for k in range(6)] for b in range(64)), key=value)
        assert decode(s, t).astype(int).tolist() == best


def test_weak_labels(spark, odd, empty):
    good, bad = pattern("This is a plain sentence of words. " + " ".join(f"w{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(30)) + "."), pattern("x### y### z$$$ " * 20)
    posterior, share, theta = fit_labellers({good: 80, bad: 20})
    assert posterior[good] > 0.9 > 0.1 > posterior[bad] and abs(theta.sum(2) - 1).max() < 1e-9
    got = weak_quality(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got) and weak_quality(empty).count() == 0


def test_letter_words():
    assert letter_words("Ab m² ½ x_y 12三") == ["ab", "m", "x", "y", "三"] and letter_words("½ ² 7 _ !") == letter_words(None) == []
    assert Model(["en"], {"ab": [3]}, [3]).predict("½ ² 7", {}) == ("und", 0.0)


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = queries.op2_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id")
    rate = both.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert rate >= 0.97
    assert docs.filter(held_out()).count() == both.filter("held_out").count()
    got = identify_held_out(odd).collect()
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (0, 1, 2)} == {("und", 0.0)}
    assert identify_held_out(empty).count() == 0 and len(got) == odd.count()
    m = Model(["a", "b"], {"house": [9, 0], "maison": [0, 9]}, [9, 9])
    assert m.predict("house", {})[0] == "a" and m.predict("maisons", {})[0] == "b" and m.predict("12 !", {}) == ("und", 0.0)


def test_packing(spark, odd):
    rng = random.Random(3)
    for _ in range(20):
        n = [rng.choice([1, 5, 60, 100, 128, 200, 256]) for _ in range(rng.randrange(1, 80))]
        bins, offsets, capacity = pack(n, (64, 128, 256))
        for b in range(len(capacity)):
            own = sorted((offsets[k], n[k]) for k in range(len(n)) if bins[k] == b)
            assert all(a + x == c for (a, x), (c, _) in zip(own, own[1:])) and own[0][0] == 0
            used = sum(x for _, x in own)
            assert used <= capacity[b] and capacity[b] == min(c for c in (64, 128, 256) if c >= used)
    docs = spark.createDataFrame([(1, 20_000), (2, None), (3, 0), (None, 7), (4, 5), (4, 5)], "doc_id bigint, n_tokens bigint")
    got = pack_documents(docs, shard=3).collect()
    assert Counter(r["doc_id"] for r in got) == {1: 3, 2: 1, 3: 1, None: 1, 4: 2} and sum(r["length"] for r in got) == 20_017
    assert pack_documents(docs.limit(0)).count() == 0


def test_budget_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000)], "top string, leaf string, supply bigint")
    even = {"top": {"a": 1, "b": 1}, "leaf": {"x": 1, "y": 1}}
    got = {(r["top"], r["leaf"]): r["target"] for r in budgets(leaves, ["top", "leaf"], F.lit(200), 1, even).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    got = {(r["top"], r["leaf"]): r["target"] for r in budgets(leaves.filter("supply = 10 OR top = 'b'"), ["top", "leaf"], F.lit(200), 1, even).collect()}
    assert got == {("a", "x"): 10, ("b", "x"): 190}


def test_mixing(spark, odd, empty):
    tree = {"lang": F.col("lang"), "source": F.col("source")}
    got = mix(odd, tree, share=0.5).collect()
    assert len(got) == odd.count() and all(r["copies"] == 0 for r in got if r["n_tokens"] == 0)
    assert mix(empty, tree, share=0.5).count() == 0
    df = queries.op10_mixing(spark, SF)
    cur = duck("sf0.001").execute(queries.ORACLES["op10_mixing"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 8))
    v[100:300] = v[50]  # a very common vector, also a query
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (None, [1.0] * 8), (1050, [1.0] * 3)]
    got = nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), cell_rows=64).collect()
    size = np.sqrt((v * v).sum(1))
    hits = 0
    for q in range(0, 600, 50):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        cos = v @ v[q] / (size * size[q])
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(cos[i] - s) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(sorted((i for i in range(600) if i != q), key=lambda i: (-round(cos[i], 12), i))[:5]))
    assert hits >= 0.9 * 60 and {r["query_id"] for r in got} == set(range(0, 600, 50))
    few = nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1)]
    assert nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0
    assert abs(chi_square(18.307, 10) - 0.95) < 1e-4


def test_tool_calls(spark):
    tools = spark.createDataFrame([("f", "a", "integer", True), ("f", "b", "string", False)], "name string, param string, type string, required boolean")
    calls = [(1, 5, "c1", "f", '{"b": "é\\"", "a": 1}'), (1, 1, "c2", "f", '{"a": "x"}'), (1, 3, "c3", "g", "{}"), (1, 7, "c4", "f", '{"z": {"y": 1, "x": 2}}'),
             (2, 1, "c1", "f", "no json"), (2, 2, "c2", "f", None), (None, 1, "c9", "f", "{}"), (1, 5, "c1", "f", '{"b": "é\\"", "a": 1}')]
    results = [(1, "c1", "r1"), (1, "c1", "r0"), (9, "c1", "lost"), (1, "c2", 'q"\n')]
    depends = [(1, "c2", "c4"), (1, "c3", "c2"), (1, "c1", "nowhere"), (2, "c1", "c2"), (2, "c2", "c1")]
    calls = spark.createDataFrame(calls, "conv_id bigint, turn bigint, call_id string, name string, arguments string")
    results = spark.createDataFrame(results, "conv_id bigint, call_id string, content string")
    depends = spark.createDataFrame(depends, "conv_id bigint, call_id string, on string")
    got = {(r["conv_id"], r["call_id"]): r for r in link_tool_calls(calls, results, tools, depends).collect()}
    assert [k for k in sorted((k for k in got if k[0] == 1), key=lambda k: got[k]["seq"])] == [(1, "c1"), (1, "c4"), (1, "c2"), (1, "c3")]
    assert got[1, "c1"]["valid"] and got[1, "c1"]["linked"] and got[2, "c1"]["late"] and not got[1, "c3"]["late"]
    assert got[1, "c1"]["json"] == '{"arguments":{"a":1,"b":"é\\""},"id":"c1","name":"f","result":"r0"}'
    assert json.loads(got[1, "c2"]["json"])["result"] == 'q"\n' and got[1, "c2"]["errors"] == ["wrong type of a"]
    assert got[1, "c3"]["errors"] == ["unknown tool"] and got[1, "c4"]["errors"] == ["missing a", "unknown parameter z"]
    assert got[2, "c1"]["errors"] == ["arguments are not JSON"] == got[2, "c2"]["errors"]
    assert link_tool_calls(calls.limit(0), results, tools, depends).count() == 0


def order_plainly(turn, links):
    """Places by repeated passes; None where they never settle."""
    place = {c: (t, 0) for c, t in turn.items()}
    for _ in range(len(turn) + 1):
        new = {c: max([place[c], *[(place[d][0], place[d][1] + 1) for a, d in links if a == c]]) for c in turn}
        if new == place:
            return sorted(turn, key=lambda c: (place[c], turn[c], c))
        place = new
    return None


def test_order_of_long_chains_and_cycles(spark):
    """A chain of 300, random links without and with cycles, and links with one call as a hub."""
    rng = random.Random(11)
    turn, links = {0: {k: k for k in range(300)}}, {0: {(k, k + 1) for k in range(299)}}
    for v in range(1, 40):
        n = rng.randrange(2, 12)
        turn[v] = {k: rng.randrange(n) for k in range(n)}
        rank = rng.sample(range(n), n)
        pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))}
        links[v] = {(a, b) for a, b in pairs if a != b and (rank[a] > rank[b] or v % 5 == 0)}
    name = lambda k: f"c{k:03d}"
    calls = spark.createDataFrame([(v, name(k), t) for v in turn for k, t in turn[v].items()], "conv_id bigint, call_id string, turn bigint")
    depends = spark.createDataFrame([(v, name(a), name(b)) for v in links for a, b in links[v]], "conv_id bigint, call_id string, on string")
    got = order_calls(calls, depends).collect()
    for v in turn:
        want = order_plainly(turn[v], links[v])
        mine = [r["call_id"] for r in sorted((r for r in got if r["conv_id"] == v), key=lambda r: r["seq"])]
        assert {r["late"] for r in got if r["conv_id"] == v} == {want is None}, v
        assert mine == [name(k) for k in (want or sorted(turn[v], key=lambda k: (turn[v][k], k)))], v


def left_by_all_pairs(rows):
    """Smallest doc_id of each group of texts whose five-word shingles are 0.8 alike or more, comparing all pairs."""
    sets = []
    for k, t in sorted(rows):
        w = t.encode().lower().split()
        sets.append((k, {b" ".join(w[x:x + 5]) for x in range(max(1, len(w) - 4))}))
    root = {k: k for k, _ in sets}
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return set(root.values())


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, SF)
    assert kept.columns == corpus_pipeline.COLUMNS
    first = corpus_pipeline.near_dedup(spark, kept, SF)
    assert {r["doc_id"] for r in first.collect()} == left_by_all_pairs([(r["doc_id"], r["text"]) for r in kept.collect()])
    shorter = corpus_pipeline.substring_dedup(spark, first, SF).collect()
    want = removed_plainly([(r["doc_id"], r["text"]) for r in first.collect()])
    assert {r["doc_id"]: len(r["text"].split()) for r in shorter}.keys() == want.keys()
    assert all(len(r["text"].encode().split()) == want[r["doc_id"]][0] - want[r["doc_id"]][1] for r in shorter)
    assert corpus_pipeline.run(spark, SF).count() > 0
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).count() == 0
