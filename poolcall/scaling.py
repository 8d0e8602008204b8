"""Helpers that keep hot keys and global orders away from single tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.session import collect_bounded, cut

HOT_SHARE = 1 / 200  # a key with this share of the rows is split; at most 200 keys can be
SALTS = 64
FLOOR = 100_000


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE, floor: int = FLOOR) -> list:
    """Keys holding at least ``share`` of the rows (and ``floor`` rows). No more than 1/share exist,
    so the list is bounded whatever the data. Counting combines on the map side."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    top, total = counts.agg(F.max("n_"), F.sum("n_")).first()
    if top is None or top < max(floor, total * share):
        return []
    return collect_bounded(counts.filter(F.col("n_") >= max(floor, total * share)).select(*keys), int(1 / share) + 1)


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate lets it broadcast ``df`` (the same figure its planner compares)."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(size)) <= int(limit)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], salt_by: list[str],
                how: str = "inner", share: float = HOT_SHARE, floor: int = FLOOR) -> DataFrame:
    """Equi join in which the hot keys of ``big`` are spread over SALTS sub-keys.

    Rows of ``small`` are repeated only for hot keys, so the result is exactly that of the plain join.
    ``how`` is inner or left (``big`` on the left)."""
    if floor >= FLOOR and fits_broadcast(small):
        return big.join(small, keys, how)  # planned as a broadcast join: no key is ever shuffled
    hot = hot_keys(big, keys, share, floor)
    if not hot:
        return big.join(small, keys, how)
    is_hot = reduce(lambda a, b: a | b,
                    (reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.lit(r[k])) for k in keys)) for r in hot))
    salted = big.withColumn("salt_", F.when(is_hot, F.pmod(F.xxhash64(*salt_by), F.lit(SALTS))).otherwise(F.lit(0)))
    spread = small.withColumn(
        "salt_", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    ).withColumn("salt_", F.col("salt_").cast("bigint"))
    return salted.withColumn("salt_", F.col("salt_").cast("bigint")).join(spread, keys + ["salt_"], how).drop("salt_")


def ordered_blocks(df: DataFrame, *order: Column) -> DataFrame:
    """Range-partition by ``order`` and fix each row's block number in a written table.

    Rows with equal ``order`` share a block, so callers first make the order unique
    (aggregate by value, or add a key)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("blk_", F.spark_partition_id()))


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals over a global order, without a single-task window.

    Each block is summed on its own and shifted by the totals of the blocks before it; the block
    table has one row per shuffle partition."""
    blocks = ordered_blocks(df, *order)
    per_block = blocks.groupBy("blk_").agg(*[F.sum(c).alias(f"{n}_t") for n, c in sums.items()])
    before = W.orderBy("blk_").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select("blk_", *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_o") for n in sums])
    inside = W.partitionBy("blk_").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = blocks
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside))
    out = out.join(offsets, "blk_")
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"{n}_o"))
    return out.drop("blk_", *[f"{n}_o" for n in sums])


def rank_in_groups(df: DataFrame, group: list[str], order: list[Column], out: str = "rank_") -> DataFrame:
    """1-based rank by ``order`` inside each group, also where one group holds most of the rows.

    Rows are range-partitioned by (group, order), numbered inside their block, and shifted by the rows of the
    same group in earlier blocks; that table has at most (groups + blocks) rows. ``order`` must be unique."""
    blocks = ordered_blocks(df, *[F.col(g) for g in group], *order)
    sizes = blocks.groupBy(*group, "blk_").agg(F.count(F.lit(1)).alias("n_"))
    before = W.partitionBy(*group).orderBy("blk_").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "blk_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("o_"))
    inside = W.partitionBy("blk_", *group).orderBy(*order)
    return (blocks.withColumn("r_", F.row_number().over(inside)).join(offsets, [*group, "blk_"])
            .withColumn(out, F.col("r_") + F.col("o_")).drop("blk_", "r_", "o_"))


def grouped_totals(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running totals by ``order`` inside each group, safe for a group holding most of the rows.

    The grouped form of :func:`running_totals`; ``order`` must be unique inside a group."""
    blocks = ordered_blocks(df, *[F.col(g) for g in group], *order)
    per = blocks.groupBy(*group, "blk_").agg(*[F.sum(c).alias(f"{n}_t") for n, c in sums.items()])
    before = W.partitionBy(*group).orderBy("blk_").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select(*group, "blk_", *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_o") for n in sums])
    inside = W.partitionBy("blk_", *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = blocks
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(inside))
    out = out.join(offsets, [*group, "blk_"])
    for n in sums:
        out = out.withColumn(n, F.col(n) + F.col(f"{n}_o"))
    return out.drop("blk_", *[f"{n}_o" for n in sums])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give every core work when a scan has fewer splits than the cluster has cores, before a step that multiplies
    rows. A large input has enough splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
