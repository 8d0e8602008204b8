"""Packing: the placement rule against a plain scan over all open bins, and rows that cannot be told apart."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from poolcall.llm.packing import SIZES, cost, pack, pack_documents


def scanned(lengths, sizes):
    """Longest first; the fullest open bin with room, else a new one of least cost per token it can expect to hold."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    opened, bins, offsets = [], {}, {}
    for done, k in enumerate(order):
        n, rest = lengths[k], sorted(lengths[x] for x in order[done + 1:])
        fits = [b for b, (size, used) in enumerate(opened) if size - used >= n]
        if fits:
            b = min(fits, key=lambda b: (opened[b][0] - opened[b][1], b))
        else:
            def rate(s):
                held = n + min(s - n, sum(x for x in rest if x <= s - n))
                return cost(s) / held, s
            b = len(opened)
            opened.append([min((s for s in sizes if s >= n), key=rate), 0])
        bins[k], offsets[k] = b, opened[b][1]
        opened[b][1] += n
    return bins, offsets, [min(s for s in sizes if s >= used) for _, used in opened]


def test_placement_against_a_plain_scan():
    rng = random.Random(4)
    for sizes in (SIZES, (10, 25, 40)):
        for _ in range(40):
            lengths = [rng.randint(1, max(sizes)) if rng.random() < 0.2 else rng.randint(1, max(sizes) // 5) for _ in range(rng.randint(0, 70))]
            bins, offsets, capacities = pack(lengths, sizes)
            b, o, c = scanned(lengths, sizes)
            assert (bins, offsets, capacities) == ([b[k] for k in range(len(lengths))], [o[k] for k in range(len(lengths))], c)


def test_rows_that_agree_are_dealt_over_the_shards(spark):
    """Forty thousand rows without id and of one length, others with ids; more columns with names of the result."""
    same = spark.range(40_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(100).alias("n_tokens"), F.lit("x").alias("shard"), F.lit(1).alias("bin"))
    rest = spark.range(960).select(F.col("id").alias("doc_id"), (F.col("id") % 700).cast("int").alias("n_tokens"), F.lit("y").alias("shard"), F.lit(2).alias("bin"))
    docs = same.unionByName(rest)
    got = pack_documents(docs).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == 40_960 and len(sizes) == 10 and max(sizes.values()) <= 4_300
    again = pack_documents(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert pack_documents(docs.limit(0)).count() == 0
    fill = Counter()
    for r in got:
        if r["bin"] is not None:
            fill[r["shard"], r["bin"], r["capacity"]] += r["length"]
    assert all(used <= size for (_, _, size), used in fill.items())
    assert sum(fill.values()) == 4_000_000 + sum(k % 700 for k in range(960))
