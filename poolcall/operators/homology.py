"""Homologous transcripts: reciprocal edges, one-to-one matching, groups across sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolcall.session import collect_bounded, cut


def reciprocal(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, score) kept where the way back exists, scores of both ways added; src < dst."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("score").alias("back"))
    return edges.join(back, ["src", "dst"]).filter("src < dst").select("src", "dst", (F.col("score") + F.col("back")).alias("score"))


def greedy_match(edges: DataFrame) -> DataFrame:
    """One-to-one pairs by falling score (ties by names).

    Each round takes every edge that is best for both its ends and removes their ends: the greedy order would take
    exactly these too, and many are found per round. Each round is written, so lineage does not grow."""
    best = F.struct((-F.col("score")).alias("k"), "src", "dst")
    left, out = cut(edges), None
    while True:  # the best edge of all goes in each round, so edges run out
        a = left.groupBy("src").agg(F.min(best).alias("m")).select("m.src", "m.dst")
        b = left.groupBy("dst").agg(F.min(best).alias("m")).select("m.src", "m.dst")
        took = cut(a.join(b, ["src", "dst"]).join(left, ["src", "dst"]).select("src", "dst", "score"))
        if took.isEmpty():
            break
        out = took if out is None else out.unionByName(took)
        left = cut(left.join(took.select("src"), "src", "left_anti").join(took.select("dst"), "dst", "left_anti"))
    return out if out is not None else edges.limit(0)


def homology_groups(edges: DataFrame) -> DataFrame:
    """Groups of transcripts across sets from directed scores (set_a, a, set_b, b, score): rows (grp, tx).

    The two closest sets are joined first: matched transcripts become one, its edges the mean of its members' where
    both have them. Sets are few, so their order is planned from a small table of summed scores. Without an edge
    between two sets there are no groups."""
    e, members, k = cut(edges), None, 0
    while True:
        near = e.filter("set_a < set_b").groupBy("set_a", "set_b").agg(F.sum("score").alias("s"), F.count(F.lit(1)).alias("n"))
        pairs = collect_bounded(near.orderBy(F.desc(F.col("s") / F.col("n")), "set_a", "set_b"), 4096)
        if not pairs:
            break
        x, y = pairs[0].set_a, pairs[0].set_b
        k += 1
        new = f"J{k}"
        two = e.filter(((F.col("set_a") == x) & (F.col("set_b") == y)) | ((F.col("set_a") == y) & (F.col("set_b") == x)))
        one_way = two.select(F.when(F.col("set_a") == x, F.concat(F.lit("0"), "a")).otherwise(F.concat(F.lit("1"), "a")).alias("src"),
                             F.when(F.col("set_b") == x, F.concat(F.lit("0"), "b")).otherwise(F.concat(F.lit("1"), "b")).alias("dst"), "score")
        m = greedy_match(reciprocal(one_way)).select(F.expr("substring(src, 2)").alias("p"), F.expr("substring(dst, 2)").alias("q"))
        m = cut(m.withColumn("tx", F.concat(F.lit(new + ":"), "p", F.lit("|"), "q")))
        old = members
        parts = m.select("tx", F.explode(F.array("p", "q")).alias("part"))
        if old is None:
            members = parts.select("tx", F.col("part").alias("leaf"))
        else:
            known = parts.join(old.select(F.col("tx").alias("part"), "leaf"), "part", "left").select("tx", F.coalesce("leaf", "part").alias("leaf"))
            members = known.unionByName(old.join(parts.select(F.col("part").alias("tx")), "tx", "left_anti"))
        members = cut(members)
        rest = e.filter(~F.col("set_a").isin(x, y) & ~F.col("set_b").isin(x, y))
        out_ = e.filter(F.col("set_a").isin(x, y) & ~F.col("set_b").isin(x, y))
        in_ = e.filter(~F.col("set_a").isin(x, y) & F.col("set_b").isin(x, y))
        link = m.select("tx", F.explode(F.array("p", "q")).alias("part"))
        so = out_.join(link, F.col("a") == F.col("part")).groupBy("tx", "set_b", "b").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).filter("n = 2")
        si = in_.join(link, F.col("b") == F.col("part")).groupBy("set_a", "a", "tx").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n")).filter("n = 2")
        e = cut(rest.select("set_a", "a", "set_b", "b", F.col("score").cast("double").alias("score"))
                .unionByName(so.select(F.lit(new).alias("set_a"), F.col("tx").alias("a"), "set_b", "b", "score"))
                .unionByName(si.select("set_a", "a", F.lit(new).alias("set_b"), F.col("tx").alias("b"), "score")))
    if members is None:
        return e.select(F.col("a").alias("grp"), F.col("a").alias("tx")).limit(0)
    return members.select(F.col("tx").alias("grp"), F.col("leaf").alias("tx"))
