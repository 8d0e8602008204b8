"""Best-fit packing into sequences of several permitted lengths."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
SHARD = 4096  # documents packed together
RUN = 4096  # copies of a row that are dealt out at a time
ATTENTION = 8192.0  # tokens at which the quadratic part of a sequence's cost equals the linear part
FIXED = 16.0  # cost of a sequence besides its tokens

PACKED = "doc_id bigint, piece int, start bigint, length bigint, shard int, bin int, capacity int, offset bigint"


def cost(size: int) -> float:
    return FIXED + size + size * size / ATTENTION


def pack(lengths: list[int], sizes: tuple = SIZES) -> tuple[list[int], list[int], list[int]]:
    """Bin of each item, its offset there, and each bin's final capacity. Items are at most ``max(sizes)`` long.

    Items come longest first, ties in the given order. One goes to the open bin that it fills best (ties: the
    older bin). If none has room, the bin opened is the one of least cost per token that it can expect to hold: the item
    and, up to its size, the waiting items short enough for the space left. At the end each bin shrinks to the
    smallest permitted length that holds its contents."""
    sizes = tuple(sorted(sizes))
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    waiting = [lengths[k] for k in reversed(order)]  # ascending; a suffix is taken off as items are placed
    below = [0]
    for n in waiting:
        below.append(below[-1] + n)
    spaces: list[tuple[int, int]] = []
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    for done, k in enumerate(order):
        n, left = lengths[k], len(lengths) - done - 1
        at = bisect_left(spaces, (n, -1))
        if at < len(spaces):
            room, b = spaces.pop(at)
        else:
            b = len(filled)
            filled.append(0)
            room = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / (n + min(s - n, below[min(left, bisect_left(waiting, s - n + 1))])), s))
        bins[k], offsets[k] = b, filled[b]
        filled[b] += n
        if room > n:
            insort(spaces, (room - n, b))
    return bins, offsets, [sizes[bisect_left(sizes, f)] for f in filled]


def _pack_shard(sizes: tuple):
    most = max(sizes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable", na_position="first")
        items = []
        for doc, n in zip(rows["doc_id"].tolist(), rows["n_tokens"].tolist()):
            doc = None if pd.isna(doc) else int(doc)
            items += [(doc, p, p * most, min(most, n - p * most)) for p in range(max(1, -(-n // most)))]
        real = [k for k, x in enumerate(items) if x[3]]
        bins, offsets, capacities = pack([items[k][3] for k in real], sizes)
        place = {k: (b, capacities[b], o) for k, b, o in zip(real, bins, offsets)}
        shard = int(rows["shard"].iloc[0])
        out = pd.DataFrame([(*x, shard, *place.get(k, (None, None, 0))) for k, x in enumerate(items)],
                           columns=["doc_id", "piece", "start", "length", "shard", "bin", "capacity", "offset"])
        return out.astype({"doc_id": "Int64", "bin": "Int64", "capacity": "Int64"})

    return run


def pack_documents(docs: DataFrame, sizes: tuple = SIZES, shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, n_tokens)`` to one row per piece: which bin of which shard holds it, the bin's capacity, and where.

    A document over the largest permitted length is cut into pieces of that length and a rest, ``start`` telling where;
    every token is in exactly one bin. Documents without tokens (null counts as zero) get a row without a bin. Rows
    are dealt by a hash into shards of about ``shard`` documents, as many as the table needs, each packed by one task; rows
    that agree in both columns, such as those without id and of one length, are counted and dealt in turn, one shard after
    the other. So no task grows with the table, and the bins do not depend on partitions. A repeated row is packed again;
    further columns are ignored, very long documents are lengths here; an empty table gives an empty result."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).cast("bigint").alias("n_tokens"))
    shards = max(1, -(-rows.count() // shard))
    alike = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n_"))
    runs = alike.withColumn("first_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_") - 1, F.lit(RUN).cast("bigint"))))
    each = runs.withColumn("nth_", F.explode(F.sequence("first_", F.least(F.col("n_"), F.col("first_") + RUN) - 1)))
    at = F.pmod(F.xxhash64(F.lit(11), "doc_id", "n_tokens"), F.lit(shards)) + F.col("nth_")
    dealt = each.select("doc_id", "n_tokens", F.pmod(at, F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(tuple(sizes)), PACKED)
