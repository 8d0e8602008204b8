"""Near copies and the pipeline around them, on planted copies."""

from __future__ import annotations

import random

import corpus_pipeline
from poolcall.llm.near_copies import one_of_near_copies, shingle_set
from poolcall.llm.simhash import one_of_each

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def alike(a, b):
    a, b = set(shingle_set(a).tolist()), set(shingle_set(b).tolist())
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(0, len(words), 7), n):
        out[k] = f"new{rng.randrange(10**6)}"
    return out


def test_near_copies_at_five_words_go_and_others_stay(spark):
    rng = random.Random(1)
    rows, gone = [], set()
    for k in range(60):
        base = [f"w{rng.randrange(20_000)}" for _ in range(300)]
        other = edited(rng, base, rng.choice([1, 3, 5, 6, 7, 9, 12]))
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(other))]
        if alike(rows[-2][1], rows[-1][1]) >= 0.8:
            gone.add(10 * k + 1)
    docs = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in rows], DDL)
    assert 20 < len(gone) < 60
    want = {k for k, _ in rows} - gone
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert {r["doc_id"] for r in one_of_each(docs).collect()} != want


def test_links_among_many_copies_are_all_found(spark):
    """Copies of one text whose pairs are partly alike enough and partly not: what is left is what all pairs give."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(300)]
    texts = [" ".join(edited(rng, base, rng.choice([1, 2, 3, 4, 5, 6]))) for _ in range(80)]
    near = [[j for j in range(80) if alike(texts[i], texts[j]) >= 0.8] for i in range(80)]
    root = list(range(80))
    for _ in range(80):
        root = [min(root[j] for j in near[i]) for i in range(80)]
    docs = spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in enumerate(texts)], DDL)
    assert {r["doc_id"] for r in one_of_near_copies(docs).collect()} == set(root) and len(set(root)) > 1


def test_rows_without_id_and_repeated_rows_go_through_every_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    clean = corpus_pipeline.near_dedup(spark, corpus_pipeline.quality_rules(spark, docs, sf), sf).filter("n_chars > 400").orderBy("doc_id").limit(30).collect()
    rows = [tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in clean]
    rows = [*[(None, *r[1:]) for r in rows[:10]], *rows[10:], *rows[10:20], (rows[12][0], *rows[20][1:])]
    at = spark.createDataFrame(rows, DDL)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        at = stage(spark, at, sf)
    got = at.collect()
    texts = sorted(r["text"] for r in got)
    assert len(got) == 30 and sum(r["doc_id"] is None for r in got) == 10 and len(set(texts)) == 30
    assert sorted(r["row"] for r in got) == list(range(1, 31)) and {r["row"] for r in got if r["doc_id"] is None} == set(range(21, 31))
    left = corpus_pipeline.source_mix(spark, at, sf).collect()
    assert any(r["doc_id"] is None for r in left) and len({r["row"] for r in left}) == len(left)
    assert corpus_pipeline.packing(spark, spark.createDataFrame(left, at.schema), sf).select("doc_id").filter("doc_id IS NULL").count() >= 1


def test_passages_go_from_rows_without_id_or_of_the_same_id(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(20_000)}" for _ in range(100))
    rows = [(k, f"{passage} own{n}", "en", "s1", 1) for n, k in enumerate((5, 5, None, None))]
    got = corpus_pipeline.substring_dedup(spark, spark.createDataFrame(rows, DDL), "").collect()
    assert sorted(len(r["text"].split()) for r in got) == [1, 1, 1, 101]
    assert [r["doc_id"] for r in got if len(r["text"].split()) == 101] == [5]
    nothing = spark.createDataFrame([], DDL)
    assert all(stage(spark, nothing, "/root/testdata/sf0.001").count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_fingerprints_name_pairs_and_sets_settle_them(spark, monkeypatch):
    """Near copies pass through fingerprints and blocks; of the pairs named, only those at least 0.8 alike are linked."""
    from poolcall.llm import set_join
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(20_000)}" for _ in range(300)] for _ in range(20)]
    texts = [" ".join(w) for base in bases for w in (base, edited(rng, base, 1), edited(rng, base, 12))]
    checked, linked = [], set_join._linked
    monkeypatch.setattr(set_join, "_linked", lambda pairs, sets: checked.append({(r["x"], r["y"]) for r in pairs.collect()}) or linked(pairs, sets))
    named, pairs_of = [], set_join.print_pairs
    monkeypatch.setattr(set_join, "print_pairs", lambda nodes: named.append(pairs_of(nodes)) or named[0])
    got = {r["doc_id"] for r in one_of_near_copies(spark.createDataFrame([(k, t, "en", "s1", len(t)) for k, t in enumerate(texts)], DDL)).collect()}
    gone = {k for k in range(60) if k % 3 and alike(texts[k - k % 3], texts[k]) >= 0.8}
    assert got == set(range(60)) - gone and len(gone) >= 20
    assert named and checked[0] and len(checked) > 1
