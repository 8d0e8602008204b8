"""Quality checks over calls: rank tests, identity sizes, doublet goodness of fit, allowed identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.functions.cdf import chi2_cdf, normal_cdf, poisson_cdf
from poolcall.scaling import running_totals


def rank_sums(calls: DataFrame, group: str = "id", value: str = "llr") -> DataFrame:
    """Mann-Whitney statistics of each group against all other rows.

    Tied values share a rank, so ranks are worked out on the table of distinct values (running counts over range
    partitions, no single sorted task) and only counts per (group, value) go on from there."""
    per = calls.groupBy(group, value).agg(F.count(F.lit(1)).alias("c"))
    vals = per.groupBy(value).agg(F.sum("c").alias("t"))
    ranked = running_totals(vals, [F.col(value)], {"upto": F.col("t")}).withColumn(
        "mean_rank", F.col("upto") - (F.col("t") - 1) / 2)
    all_ = ranked.agg(F.sum("t").alias("n"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    g = (per.join(ranked.select(value, "mean_rank"), value).groupBy(group)
         .agg(F.sum("c").alias("n1"), F.sum(F.col("c") * F.col("mean_rank")).alias("ranksum")))
    n1, n2 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double")
    tot = F.col("n").cast("double")
    return g.join(F.broadcast(all_)).select(  # one row
        group, "n1", (F.col("n") - F.col("n1")).alias("n2"),
        (F.col("ranksum") - n1 * (n1 + 1) / 2).alias("u"), (n1 * n2 / 2).alias("mean_u"),
        F.sqrt(n1 * n2 * (tot + 1) / 12 - n1 * n2 * F.col("ties") / (12 * tot * (tot - 1))).alias("sigma_u"))


def lower_llr_p(stats: DataFrame) -> Column:
    """One-sided p that a group's values are lower; the sign alone decides for fewer than three rows."""
    few = (F.col("n1") < 3) | (F.col("n2") < 3)
    return F.when(F.col("n1") == 0, 0.0).when(F.col("n2") == 0, 1.0) \
            .when(few, F.when(F.col("u") < F.col("mean_u"), 0.0).otherwise(1.0)) \
            .otherwise(normal_cdf(F.col("u"), F.col("mean_u"), F.col("sigma_u")))


def identity_qc(calls: DataFrame) -> DataFrame:
    """Per identity: cells, mean size of the other identities, and both test p values."""
    stats = rank_sums(calls)
    w = W.partitionBy()  # one row per identity: bounded by the pool
    s = stats.withColumn("total_", F.sum("n1").over(w)).withColumn("ids_", F.count(F.lit(1)).over(w))
    other = F.when(F.col("ids_") > 1, (F.col("total_") - F.col("n1")) / (F.col("ids_") - 1))
    s = s.withColumn("other_mean", other)
    return s.select("id", "n1", "other_mean", "u", "sigma_u", poisson_cdf(F.col("n1"), F.col("other_mean")).alias("p_cells"),
                    lower_llr_p(s).alias("p_llr"))


def pair_rank_sums(calls: DataFrame, parents: DataFrame) -> DataFrame:
    """Mann-Whitney of each (id, parent) pair alone. ``parents`` is a small table (id, parent)."""
    per = calls.groupBy("id", "llr").agg(F.count(F.lit(1)).alias("c"))
    a = per.join(parents, "id").select(F.concat_ws("|", "id", "parent").alias("pair"), "id", "llr", "c", F.lit(1).alias("own"))
    b = per.withColumnRenamed("id", "parent").join(parents, "parent").select(
        F.concat_ws("|", "id", "parent").alias("pair"), "id", "llr", "c", F.lit(0).alias("own"))
    rows = a.unionByName(b).groupBy("pair", "id", "llr").agg(
        F.sum(F.when(F.col("own") == 1, F.col("c")).otherwise(0)).alias("c1"), F.sum("c").alias("t"))
    from poolcall.scaling import grouped_totals
    r = grouped_totals(rows, ["pair"], [F.col("llr")], {"upto": F.col("t")})
    g = r.groupBy("pair", "id").agg(
        F.sum("c1").alias("n1"), F.sum(F.col("t") - F.col("c1")).alias("n2"),
        F.sum(F.col("c1") * (F.col("upto") - (F.col("t") - 1) / 2)).alias("ranksum"),
        F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    tot = n1 + n2
    return g.select("id", F.substring_index("pair", "|", -1).alias("parent"), "n1", "n2",
                    (F.col("ranksum") - n1 * (n1 + 1) / 2).alias("u"), (n1 * n2 / 2).alias("mean_u"),
                    F.sqrt(n1 * n2 * (tot + 1) / 12 - n1 * n2 * F.col("ties") / (12 * tot * (tot - 1))).alias("sigma_u"))


def doublet_chisq(calls: DataFrame) -> DataFrame:
    """Observed against expected doublet counts from singlet shares: statistic, degrees of freedom and CDF.

    ``calls`` holds (i, j); only identity counts, bounded by the pool, are compared."""
    cnt = calls.groupBy("i", "j").agg(F.count(F.lit(1)).alias("c"))
    sing = cnt.filter("i = j").select("i", F.col("c").alias("s"))
    tot = cnt.agg(F.sum(F.when(F.col("i") == F.col("j"), F.col("c"))).alias("ts"),
                  F.sum(F.when(F.col("i") != F.col("j"), F.col("c"))).alias("td"))
    a, b = sing.select("i", F.col("s").alias("sa")), sing.select(F.col("i").alias("j"), F.col("s").alias("sb"))
    pairs = (a.join(b, F.col("i") < F.col("j")).join(cnt.filter("i < j"), ["i", "j"], "left").join(F.broadcast(tot))
             .withColumn("w", F.col("sa") / F.col("ts") * (F.col("sb") / F.col("ts"))).withColumn("c", F.coalesce("c", F.lit(0))))
    share = F.col("w") / F.sum("w").over(W.partitionBy())
    e = pairs.withColumn("e", F.col("td") * share)
    return e.agg(F.sum((F.col("c") - F.col("e")) * (F.col("c") - F.col("e")) / F.col("e")).alias("chisq"),
                 (F.count(F.lit(1)) - 1).alias("df")).withColumn("cdf", chi2_cdf(F.col("chisq"), F.col("df")))


def allowed_identities(listed: DataFrame, all_pairs: bool = False) -> DataFrame:
    """Closure of a list of identities (i, j): the members of listed doublets join, and optionally every pair."""
    members = listed.select(F.explode(F.array("i", "j")).alias("m")).distinct()
    out = listed.select("i", "j").union(members.select(F.col("m").alias("i"), F.col("m").alias("j")))
    if all_pairs:
        out = out.union(members.select(F.col("m").alias("i")).join(members.select(F.col("m").alias("j")), F.col("i") < F.col("j")))
    return out.distinct()


def coded(calls: DataFrame) -> DataFrame:
    """Identities as text of member numbers, ``i`` or ``i+j``."""
    one = F.col("i").cast("string")
    return calls.select("barcode", F.when(F.col("i") == F.col("j"), one).otherwise(F.concat_ws("+", "i", "j")).alias("id"), "llr")


def singlet_parents(listed: DataFrame) -> DataFrame:
    """(id, parent) of each member that is not listed itself, with every listed doublet holding it."""
    par = listed.filter("i < j").select(F.explode(F.array("i", "j")).alias("m"), F.concat_ws("+", "i", "j").alias("parent"))
    own = listed.filter("i = j").select(F.col("i").alias("m"))
    return par.join(own, "m", "left_anti").select(F.col("m").cast("string").alias("id"), "parent")


def implausible_singlets(calls: DataFrame, listed: DataFrame) -> DataFrame:
    """Added singlets; dropped when cells are fewer and ratios lower than for every listed doublet holding them."""
    t = pair_rank_sums(coded(calls), singlet_parents(listed))
    t = t.withColumn("p_cells", poisson_cdf(F.col("n1"), F.col("n2").cast("double"))).withColumn("p_llr", lower_llr_p(t))
    return t.groupBy("id").agg(F.max("p_cells").alias("p_cells"), F.max("p_llr").alias("p_llr"), F.count(F.lit(1)).alias("parents")) \
            .withColumn("drop", (F.col("p_cells") <= 0.05) & (F.col("p_llr") <= 0.05))


def refilter(table: DataFrame, listed: DataFrame) -> DataFrame:
    """Call with added singlets allowed, drop the implausible ones, call again. Returns (barcode, i, j, llr)."""
    from poolcall.operators.likelihood import SPAN, eliminate, id_code, restrict
    from poolcall.session import collect_bounded, cut
    t = cut(table)  # scored twice
    codes = allowed_identities(listed).select("i", "j", id_code(F.col("i"), F.col("j")).alias("c"))
    allowed = [x.c for x in collect_bounded(codes, SPAN * SPAN)]
    first = eliminate(restrict(t, allowed))
    bad = {int(x.id) for x in collect_bounded(implausible_singlets(first, listed).filter("drop").select("id"), SPAN)}
    return eliminate(restrict(t, [c for c in allowed if c not in bad])) if bad else first
