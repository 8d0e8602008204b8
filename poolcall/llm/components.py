"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolcall.session import cut


ROWS_PER_TASK = 10_000


def in_few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more tasks than about ``rows`` rows are worth, so that a round over few links does not pay for every
    shuffle partition. A large table keeps its partitions."""
    return df.coalesce(rows // ROWS_PER_TASK + 1)


def _least(df: DataFrame, n: int) -> DataFrame:
    return in_few(df.groupBy("u").agg(F.min("v").alias("m")), n)


def _step(links: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over ``n`` links (u, v) with u > v."""
    both = in_few(links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
    least = _least(both, 2 * n).select("u", F.least("u", "m").alias("m"))
    large = in_few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n)
    small = _least(large, n)
    moved = large.join(small, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return in_few(moved.unionAll(small.select("u", F.col("m").alias("v"))).distinct(), n)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """``links(a, b)`` of longs to ``(node, root)``, root being the smallest node reachable. ``rows`` is their number, if
    it is known.

    Only nodes with a link appear. Each round is written to the shared folder, so a lost executor repeats one round
    at most and nothing about single nodes reaches the driver. A node with many links is a hot key of a join whose
    sides are plain exchanges, which adaptive execution splits; minima are combined before the shuffle. The loop ends
    when the link table no longer changes, which is when every link leads straight to its root."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = cut(links.distinct() if rows is None else in_few(in_few(links, rows).distinct(), rows))
    state = _state(links)
    while state[0]:
        links = cut(_step(links, state[0]))
        new = _state(links)
        if new == state:
            break
        state = new
    roots = in_few(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), state[0])
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
