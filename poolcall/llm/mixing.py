"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.llm.common import word_count
from poolcall.scaling import grouped_totals
from poolcall.session import cut

MISSING = "(none)"
ROOT = "root_"


def water_fill(children: DataFrame, parent: list[str], alloc: str = "alloc") -> DataFrame:
    """Share each parent's ``alloc`` among its children in proportion to ``weight``, none above its ``cap``.

    What a full child cannot take goes to its siblings. Children are walked by cap per weight: those that fill up come
    first, and the level at the first one that does not is the level of all the rest. One row per node, counted
    beforehand, so the windows are as small as the tree."""
    order = [F.col("cap") / F.col("weight"), *[F.col(c) for c in children.columns if c not in (*parent, "cap", "weight", alloc)]]
    ahead = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*parent).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    inside = W.partitionBy(*parent).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    taken, used = F.coalesce(F.sum("cap").over(ahead), F.lit(0)), F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    level = (F.col(alloc) - F.col("taken_")) / (F.col("all_") - F.col("used_"))
    return (children.withColumns({"taken_": taken, "used_": used, "all_": F.sum("weight").over(whole)}).withColumn("level_", level)
            .withColumn("open_", F.col("cap") > F.col("level_") * F.col("weight"))
            .withColumn("at_", F.first(F.when(F.col("open_"), F.col("level_")), ignorenulls=True).over(inside))
            .withColumn(alloc, F.when(F.col("at_").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("at_") * F.col("weight"))))
            .drop("taken_", "used_", "all_", "level_", "open_", "at_"))


def budgets(leaves: DataFrame, levels: list[str], budget: Column, epochs: int, weights: dict | None = None) -> DataFrame:
    """``leaves(*levels, supply)`` to ``(*levels, supply, target)``, target in whole tokens.

    A node can take its supply ``epochs`` times; the root's budget is cut to what the whole tree can take. A node's weight is
    the whole part of the square root of its supply, or ``weights[level][value]`` where given. A shortage stays
    among siblings as long as one has room, since a parent's share is only lowered by its own capacity."""
    nodes = leaves.agg(F.least(budget.cast("double"), (F.sum("supply") * epochs).cast("double")).alias("alloc")).withColumn(ROOT, F.lit(0))
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        level = leaves.groupBy(*path).agg(F.sum("supply").alias("supply_"))
        weight = F.greatest(F.floor(F.sqrt(F.col("supply_").cast("double"))), F.lit(1)).cast("double")
        for value, given in ((weights or {}).get(path[-1]) or {}).items():
            weight = F.when(F.col(path[-1]) == value, F.lit(float(given))).otherwise(weight)
        level = level.select(*path, (F.col("supply_") * epochs).alias("cap"), weight.alias("weight"))
        level = level.withColumn(ROOT, F.lit(0)).join(nodes, [ROOT, *path[:-1]])
        nodes = water_fill(level, [ROOT, *path[:-1]]).select(ROOT, *path, "alloc")
    return leaves.join(nodes, levels).select(*levels, "supply", F.floor("alloc").cast("bigint").alias("target"))


def mix(docs: DataFrame, levels: dict[str, Column], share: float, epochs: int = 4, seed: int = 7, weights: dict | None = None) -> DataFrame:
    """How often each document is taken: ``(doc_id, *levels, n_tokens, copies, target)``, one row per row of ``docs``.

    ``levels`` names the tree from the top down, a column expression each; a null value is the node ``(none)``. The budget
    is ``share`` of all tokens (words). A leaf passes through its documents in whole epochs, then takes
    the prefix of one more epoch in an order drawn from the seed, the epoch and the doc_id; a document is in the prefix
    if the tokens before it are under what is still to take, so a leaf may exceed its target by part of one document.
    Documents without words are never taken. Null doc_ids and repeated rows are ordered like any other. An empty
    table gives an empty result. The running totals are made over range partitions, so a leaf with most of
    the rows is spread over many tasks."""
    names = list(levels)
    rows = cut(docs.select("doc_id", *[F.coalesce(c.cast("string"), F.lit(MISSING)).alias(n) for n, c in levels.items()], word_count("text").alias("n_tokens")))
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("supply"))
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    plan = cut(budgets(leaves, names, F.floor(F.lit(total) * F.lit(float(share))), epochs, weights)
               .withColumn("full", F.when(F.col("supply") > 0, F.floor(F.col("target") / F.col("supply"))).otherwise(F.lit(0)).cast("bigint"))
               .withColumn("rest", F.col("target") - F.col("full") * F.col("supply")))
    drawn = rows.join(plan, names).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    order = [F.col("key"), F.col("doc_id"), F.col("n_tokens")]
    ran = grouped_totals(drawn, names, order, {"upto": F.col("n_tokens")})
    more = (F.col("upto") - F.col("n_tokens") < F.col("rest")) & (F.col("n_tokens") > 0)
    copies = F.when(F.col("n_tokens") > 0, F.col("full")).otherwise(F.lit(0)) + F.when(more, F.lit(1)).otherwise(F.lit(0))
    return ran.select("doc_id", *names, "n_tokens", copies.cast("bigint").alias("copies"), "target")
