"""Ranked search, set join and fill-in-middle against plain Python, on odd and adverse inputs."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from poolcall.llm import infilling, ranking, set_join
from poolcall.llm.infilling import SkipList, fill_in_middle, restore, transform
from poolcall.llm.ranking import rank_documents, terms_of
from poolcall.llm.set_join import boundary, jaccard_components, least_shared, scan_lists, subset_count
from poolcall.session import cut

DDL = "doc_id bigint, text string, lang string, n string, row string, key int, node int, score int"


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, "x", "y", 1, 2, 3) for k, t in rows], DDL)


# fill-in-middle

ODD = [None, "", " ", "a", "ab cd", "Ä€😀x", "A\n\nb\r\n", "a<P>b", "x<S", "<P", "ends with <", "1234", "é" * 50, "word " * 9000, "z" * 70_000]


def units(text):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)


@pytest.mark.parametrize("text", [t or "" for t in ODD])
def test_skip_list_finds_every_rank(text):
    own, found = units(text), SkipList(text)
    ends = np.cumsum([0, *map(len, own)])
    assert found.n == len(own)
    ranks = range(len(own) + 1) if len(own) < 200 else random.Random(1).sample(range(len(own) + 1), 200)
    assert [found.seek(r) for r in ranks] == [ends[r] for r in ranks]
    with pytest.raises(IndexError):
        found.seek(len(own) + 1)


def test_blocks_join_runs_over_their_edges(monkeypatch):
    text = "abc def  ghijkl1m" * 5
    whole = infilling.unit_widths(text).tolist()
    monkeypatch.setattr(infilling, "BLOCK", 4)
    assert infilling.unit_widths(text).tolist() == whole == [len(u) for u in units(text)]


def test_fill_in_middle(spark):
    rows = [(k, t) for k, t in enumerate(ODD * 12)] + [(None, "no id here"), (3, ODD[3])]
    got = fill_in_middle(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r, (k, t) in zip(got, rows):
        t = t or ""
        assert r["restored"] == t == restore(r["output"], r["form"]) and r["n"] == len(units(t))
        assert (r["form"] == "plain") or (t and not any(m in t for m in infilling.MARKS))
        if r["form"] != "plain":
            h = infilling.draws(k)
            a, b = sorted((h[0] % (r["n"] + 1), h[1] % (r["n"] + 1)))
            u = units(t)
            assert (r["prefix_chars"], r["middle_chars"]) == (len("".join(u[:a])), len("".join(u[a:b])))
    assert fill_in_middle(frame(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        restore("plain text", "psm")
    assert transform("abc", 5, seed=2) == transform("abc", 5, seed=2)


# ranked search

def ranked_plainly(docs, items, keep=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(k, Counter(terms(t))) for k, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, want in asked.items():
        scored = []
        for k, b in bags:
            m = 25 + 75 * sum(b.values()) * n_docs // max(n_terms, 1)
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t, x in want.items() if t in b)
            if s > 0 and k is not None:
                scored.append((-s, k))
        out += [(i, r + 1, k, -s) for r, (s, k) in enumerate(sorted(scored)[:keep])]
    return sorted(out)


@pytest.mark.parametrize("limits", [{}, {"terms_a_pass": 7, "items_a_block": 2}])
def test_ranking(spark, limits):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("the The of cat dog Öl öl x9 tree-house rain ÄÄ über snow,ice a b c d e f g".split()) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 3, 8, 40]))) for k in range(150)] + [(k, "cat dog rain") for k in range(200, 260)]
    docs += [(None, "cat rain"), (300, None), (301, " .,-"), (302, "cat " * 30_000), (7, docs[7][1]), (303, "unheard words only")]
    rng.shuffle(docs)
    items = [(1, "Cat, dog; rain"), (2, "the the the of snow"), (3, None), (4, "nowhere-found"), (None, "cat"), (5, "ÄÄ über öl"), (6, "cat"), (6, "dog tree")]
    got = rank_documents(frame(spark, docs), frame(spark, items).withColumnRenamed("doc_id", "item_id"), **limits)
    assert sorted(map(tuple, got.collect())) == ranked_plainly(docs, items)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}


def test_ranking_of_nothing(spark):
    some, none = frame(spark, [(1, "cat")]), frame(spark, []).limit(0)
    for docs, items in ((none, some), (some, none), (frame(spark, [(1, None)]), some)):
        assert rank_documents(docs, items.withColumnRenamed("doc_id", "item_id")).count() == 0
    assert terms_of("A_b`C") == [b"a", b"b", b"c"]


def test_scores_stay_exact_beyond_doubles():
    """A block whose sums pass 2**53 is scored in whole numbers."""
    import pyarrow as pa
    weights, asked = np.array([30_000, 7]), np.array([[400_000.0], [1.0]])
    run = ranking._class_scores(np.array([0, 1]), weights, np.array([9]), asked, 10)
    bag = np.array([[0, 1000], [1, 3]], np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([5]), pa.array([25]), pa.array([bag.tobytes()])], names=["class", "first", "m", "bag"])
    want = 400_000 * 30_000 * (10**12 // (1_000_000 + 200)) + 7 * (3 * 10**9 // (3000 + 200))
    assert next(iter(run([batch]))).to_pylist() == [{"item_id": 9, "class": 1, "first": 5, "score": want}] and want > 1 << 53


# set join

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def joined_plainly(docs):
    docs = [(k, shingles(t)) for k, t in docs if k is not None]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, (_, a) in enumerate(docs):
        for j in range(i):
            b = docs[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(docs):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), least[find(k)]) for k, (i, s) in enumerate(docs))


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(words)), min(n, len(words))):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def texts_of_all_sizes(rng):
    """Chains, dense groups, alike-but-not-enough groups and a shared passage, from one word to some hundred."""
    out = []
    for size in (1, 2, 4, 5, 6, 8, 9, 10, 12, 14, 16, 18, 19, 20, 21, 22, 24, 25, 30, 60, 200):
        for _ in range(4):
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            out.append(base)
            for _ in range(4):
                base = base[rng.randrange(3):] + [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3))] if rng.random() < .7 else edited(rng, base, 1 + size // 60)
                out.append(base or ["w"])
    passage = [f"p{k}" for k in range(60)]
    out += [[f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(100))] + passage for _ in range(60)]
    dense = [f"d{k}" for k in range(150)]
    out += [edited(rng, dense, rng.choice([1, 2, 3, 4])) for _ in range(70)]
    return [" ".join(w) for w in out]


def test_set_join_against_all_pairs(spark):
    rng = random.Random(8)
    texts = texts_of_all_sizes(rng)
    texts += [texts[5].upper(), texts[300], None, "", " \t\n", "one two three four five " * 400]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[9]), (40, "another text under the same id as before")]
    rng.shuffle(rows)
    got = jaccard_components(frame(spark, rows))
    want = joined_plainly(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert len({c for _, _, c in want}) < len(want) - 100
    assert jaccard_components(frame(spark, []).limit(0)).count() == 0
    assert sorted(jaccard_components(frame(spark, [(1, None), (2, " ")])).collect()) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("x", [0, 6, 16])
def test_set_join_is_the_same_at_every_boundary(spark, monkeypatch, x):
    rng = random.Random(9)
    rows = list(enumerate(texts_of_all_sizes(rng)[:300]))
    monkeypatch.setattr(set_join, "boundary", lambda sizes: x)
    assert sorted(map(tuple, jaccard_components(frame(spark, rows)).collect())) == joined_plainly(rows)


def test_lists_of_texts_that_are_not_alike_enough_are_scanned_in_cells(spark, monkeypatch):
    """One list of many texts about 0.78 alike: rounds find next to nothing, cells the rest."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(100)]
    rows = list(enumerate(" ".join(edited(rng, base, 1) + [f"x{rng.randrange(10**6)}" for _ in range(rng.choice([10, 12, 14]))]) for _ in range(90)))
    monkeypatch.setattr(set_join, "CELL", 16)
    assert sorted(map(tuple, jaccard_components(frame(spark, rows)).collect())) == joined_plainly(rows)


def test_least_shared_and_scans():
    for n in range(1, 60):
        for m in range(1, 60):
            for k in range(min(n, m) + 1):
                assert (100 * k >= 80 * (n + m - k)) == (k >= least_shared(n, m))
    assert boundary({}) == 0 and boundary({1: 10**6, 2: 10, 12: 1}) >= 1 and subset_count(1) == 1
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 12, 11)) for _ in range(40)]
    n, label = np.array([len(s) for s in sets]), np.arange(40)
    links = scan_lists(n, sets, label)
    near = [(i, j) for i in range(40) for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    root = {k: k for k in range(40)}
    for i, j in links:
        assert (max(i, j), min(i, j)) in near
        old, new = root[i], root[j]
        root = {k: new if r == old else r for k, r in root.items()}
    assert all(root[i] == root[j] for i, j in near) and near


def test_rounds_over_few_links_take_few_tasks(spark):
    """A chain and a star, with many shuffle partitions that are not merged: the roots are right, and the tasks follow the links."""
    from poolcall.llm.components import components
    sc, own = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    links = cut(spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101 + k) for k in range(40)], "a long, b long"))
    try:
        for k, v in zip(own, ("64", "false")):
            spark.conf.set(k, v)
        sc.setJobGroup("few", "few")
        got = {(r["node"], r["root"]) for r in components(links, links.count()).collect()}
        seen = sc.statusTracker()
        jobs = [seen.getJobInfo(j) for j in seen.getJobIdsForGroup("few")]
        ran = [info.numCompletedTasks for j in jobs for s in j.stageIds if (info := seen.getStageInfo(s))]
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in own.items():
            spark.conf.set(k, v)
    assert got == {(k, 0) for k in range(41)} | {(k, 100) for k in range(100, 141)}
    assert ran and max(ran) < 64
