"""Tags and guides: background/foreground fit, tag set per cell, background share, label tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.functions.expr import log_gamma_sql
from poolcall.session import PASS_LIMIT, collect_bounded, cut, local_table, not_settled

MAX_TAGS = 100_000  # tag lists are panels
PHI_MAX = 1e6  # dispersion of a count that is not over-dispersed
LN2 = 0.6931471805599453


def nb_logpmf(x: str, mean: str, phi: str) -> Column:
    """Natural-log negative binomial of column x with mean and size given as SQL text."""
    g = log_gamma_sql
    return F.expr(f"({g(f'{x} + {phi}')} - {g(phi)} - {g(f'{x} + 1')} + {phi} * ln({phi} / ({phi} + {mean})) + {x} * ln({mean} / ({phi} + {mean})))")


def phi_of(mean: Column, var: Column) -> Column:
    return F.when(var > mean, F.least(mean * mean / (var - mean), F.lit(PHI_MAX))).otherwise(F.lit(PHI_MAX))


def count_histogram(counts: DataFrame) -> DataFrame:
    """Cells per (tag, count): all the mixture fit needs."""
    return counts.groupBy("tag", F.col("cnt").cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def start_values(hist: DataFrame) -> DataFrame:
    """Two starts per tag: background at the smallest or at the middle count, foreground at the largest.

    The middle comes from running cell counts over the distinct counts of a tag."""
    w = W.partitionBy("tag").orderBy("x").rowsBetween(W.unboundedPreceding, 0)  # distinct counts only
    h = hist.withColumn("upto", F.sum("n").over(w)).withColumn("tot", F.sum("n").over(W.partitionBy("tag")))
    lo_mid = F.min(F.when(F.col("upto") >= F.floor((F.col("tot") + 1) / 2), F.col("x")))
    hi_mid = F.min(F.when(F.col("upto") >= F.floor((F.col("tot") + 2) / 2), F.col("x")))
    g = h.groupBy("tag").agg(F.min("x").alias("x0"), ((lo_mid + hi_mid) / 2).alias("x1"), F.max("x").alias("x2"))
    return g.select("tag", F.explode(F.array(*[F.struct(
        F.lit(k).alias("start"), F.lit(0.5).alias("w"), F.greatest(F.col(c), F.lit(0.1)).alias("lo"), F.lit(1.0).alias("phi"),
        F.col("x2").alias("hi")) for k, c in ((0, "x0"), (1, "x1"))])).alias("s")).select("tag", "s.*")


def mixture_step(hist: DataFrame, params: DataFrame) -> DataFrame:
    """One EM pass: background NB by moments, foreground exponential by its mean, and the log-likelihood before it."""
    d = hist.join(params, "tag")
    lo = F.log("w") + nb_logpmf("x", "lo", "phi")
    hi = F.log(1 - F.col("w")) - F.log("hi") - F.col("x") / F.col("hi")
    m = F.greatest("a_", "b_")
    d = d.withColumn("a_", lo).withColumn("b_", hi).withColumn("t_", m + F.log(F.exp(F.col("a_") - m) + F.exp(F.col("b_") - m)))
    r = d.withColumn("r_", F.exp(F.col("a_") - F.col("t_")) * F.col("n")).withColumn("q_", F.col("n") - F.col("r_"))
    x = F.col("x")
    g = r.groupBy("tag", "start").agg(F.sum("r_").alias("r"), F.sum("q_").alias("q"), F.sum(F.col("r_") * x).alias("rx"),
                                      F.sum(F.col("r_") * x * x).alias("rxx"), F.sum(F.col("q_") * x).alias("qx"),
                                      F.sum(F.col("n") * F.col("t_")).alias("ll"))
    mean = F.greatest(F.col("rx") / F.col("r"), F.lit(0.1))
    var = F.col("rxx") / F.col("r") - mean * mean
    w = F.least(F.greatest(F.col("r") / (F.col("r") + F.col("q")), F.lit(1e-6)), F.lit(1 - 1e-6))
    return g.select("tag", "start", w.alias("w"), mean.alias("lo"), phi_of(mean, var).alias("phi"),
                    F.greatest(F.when(F.col("q") > 1e-9, F.col("qx") / F.col("q")).otherwise(F.lit(0.1)), F.lit(0.1)).alias("hi"), "ll")


PARAMS = "tag STRING, start INT, w DOUBLE, lo DOUBLE, phi DOUBLE, hi DOUBLE, ll DOUBLE"


def fit_tags(counts: DataFrame, passes: int = PASS_LIMIT, tol: float = 1e-6) -> DataFrame:
    """Background/foreground split per tag (w, lo, phi, hi), the better of two starts.

    The cells are read once, into (tag, count) rows; each pass is one small job over those, and only the
    parameters (two rows per tag) come back. Ends when no log-likelihood moves by more than its ``tol``-th part."""
    spark = counts.sparkSession
    hist = cut(count_histogram(counts))
    params, last = start_values(hist), None
    for _ in range(passes):
        rows = collect_bounded(mixture_step(hist, params), 2 * MAX_TAGS)
        params = local_table(spark, rows, PARAMS).drop("ll")
        ll = {(x.tag, x.start): x.ll for x in rows}
        moved = max((abs(ll[k] - last[k]) / abs(last[k]) if ll[k] != last[k] else 0.0 for k in ll), default=0.0) if last is not None else math.inf
        if moved <= tol:
            break
        last = ll
    else:
        raise not_settled("the tag split", passes, moved)
    return better_start(mixture_step(hist, params).select("tag", "start", "ll").join(params, ["tag", "start"]))


def better_start(fits: DataFrame) -> DataFrame:
    """The second start wins only with a higher likelihood, ordered means and a higher foreground."""
    a = fits.filter("start = 0").select("tag", *[F.col(c).alias(f"{c}0") for c in ("w", "lo", "phi", "hi", "ll")])
    b = fits.filter("start = 1").select("tag", "w", "lo", "phi", "hi", "ll")
    take = (F.col("ll") > F.col("ll0")) & (F.col("hi") > F.col("lo")) & (F.col("w") > 1e-6) & (F.col("w") < 1 - 1e-6) & (F.col("hi") > F.col("hi0"))
    return a.join(b, "tag").select("tag", *[F.when(take, F.col(c)).otherwise(F.col(f"{c}0")).alias(c) for c in ("w", "lo", "phi", "hi")])


def keep_by_means(fits: DataFrame) -> DataFrame:
    """Drop tags whose foreground mean is likelier under the pooled background than under the pooled foreground."""
    w = W.partitionBy()  # one row per tag of the panel
    n = F.count(F.lit(1)).over(w)
    bm, fm = F.avg("lo").over(w), F.avg("hi").over(w)
    bv = F.sum(F.col("lo") + F.col("lo") * F.col("lo") / F.col("phi")).over(w) / (n * n)
    fv = F.sum(F.col("hi") * F.col("hi")).over(w) / (n * n)
    f = fits.withColumn("bm", bm).withColumn("bv", bv).withColumn("fm", fm).withColumn("fv", fv)
    f = f.withColumn("bp", phi_of(F.col("bm"), F.col("bv"))).withColumn("fp", phi_of(F.col("fm"), F.col("fv")))
    drop = nb_logpmf("hi", "bm", "bp") > nb_logpmf("hi", "fm", "fp")
    return f.withColumn("keep", ~drop).drop("bm", "bv", "fm", "fv", "bp", "fp")


def separated(fits: DataFrame, passes: int = 50) -> list[str]:
    """Tags whose background and foreground are separated (bounded panel, so plain numpy over one row per tag).

    Separation is the background CDF at the foreground mean; a two-part beta mixture over it is fitted by moments
    and its lower part goes only if the parts are clearly apart."""
    from poolcall.functions.cdf import _beta_inc
    rows = collect_bounded(fits, MAX_TAGS)
    lo, phi, hi = (np.array([x[c] for x in rows], float) for c in ("lo", "phi", "hi"))
    sep = np.clip(_beta_inc(phi, np.floor(hi) + 1, phi / (phi + lo)), 1e-4, 1 - 1e-4)
    a = np.array([10 * sep.min(), 9.99])
    b = np.array([10 * (1 - sep.min()), 0.01])
    wt = np.array([0.5, 0.5])
    from math import lgamma
    for _ in range(passes):
        ll = np.stack([np.log(wt[k]) + lgamma(a[k] + b[k]) - lgamma(a[k]) - lgamma(b[k])
                       + (a[k] - 1) * np.log(sep) + (b[k] - 1) * np.log(1 - sep) for k in (0, 1)])
        r = np.exp(ll - ll.max(axis=0))
        r = r / r.sum(axis=0)
        wt = np.clip(r.mean(axis=1), 1e-6, 1)
        for k in (0, 1):
            tot = max(r[k].sum(), 1e-9)
            m = (r[k] * sep).sum() / tot
            v = max((r[k] * (sep - m) ** 2).sum() / tot, 1e-6)
            f = max(m * (1 - m) / v - 1, 1e-3)
            a[k], b[k] = max(m * f, 1e-3), max((1 - m) * f, 1e-3)
    low = r[0] > r[1]
    mu = a / (a + b)
    apart = low.any() and (~low).any() and _beta_inc(a[1], b[1], mu[0]) <= 0.01 and _beta_inc(a[0], b[0], mu[1]) >= 0.99
    return [x.tag for x, bad in zip(rows, low) if not (apart and bad)]


def ambient_shares(fits: DataFrame) -> DataFrame:
    """Expected share of each tag in the background."""
    return fits.withColumn("bg", F.col("lo") / F.sum("lo").over(W.partitionBy()))  # one row per tag of the panel


def enriched(counts: DataFrame, shares: DataFrame) -> DataFrame:
    """Observed tags of each cell ordered by share above background."""
    c = counts.join(shares, "tag").withColumn("tot", F.sum("cnt").over(W.partitionBy("barcode")))  # a cell's tags: at most the panel
    c = c.withColumn("excess", F.round(F.col("cnt") / F.col("tot") - F.col("bg"), 9))
    return c.withColumn("rank", F.row_number().over(W.partitionBy("barcode").orderBy(F.desc("excess"), "tag")))


def growing_scores(counts: DataFrame, fits: DataFrame) -> DataFrame:
    """Score of taking the first k enriched tags as foreground, for every k, from running sums alone.

    With foreground means h, background means l, B the background left over and y the counts inside the set:
    an inside tag has rate y·h/(H·(y+B)), an outside tag l/(y+B); the set's total y is negative binomial."""
    s = ambient_shares(fits)
    tot_lo = s.withColumn("lo_all", F.sum("lo").over(W.partitionBy()))
    e = enriched(counts, tot_lo)
    run = W.partitionBy("barcode").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy("barcode")
    x = F.col("cnt")
    e = (e.withColumn("y", F.sum(x).over(run).cast("double")).withColumn("h1", F.sum("hi").over(run))
         .withColumn("h2", F.sum(F.col("hi") * F.col("hi")).over(run)).withColumn("b", F.col("lo_all") - F.sum("lo").over(run))
         .withColumn("xh", F.sum(x * F.log2("hi")).over(run)).withColumn("xl", F.sum(x * F.log2("lo")).over(run))
         .withColumn("xl_all", F.sum(x * F.log2("lo")).over(all_)))
    rate = F.log2(F.col("y") + F.greatest(F.col("b"), F.lit(0.0)))
    multi = F.col("xh") - F.col("y") * F.log2("h1") + F.col("y") * F.log2("y") + (F.col("xl_all") - F.col("xl")) - F.col("tot") * rate
    e = e.withColumn("hp", phi_of(F.col("h1"), F.col("h2")))
    ll = multi + nb_logpmf("y", "h1", "hp") / LN2
    ll0 = F.col("xl_all") - F.col("tot") * F.log2("lo_all")
    return e.select("barcode", "tag", "rank", "tot", "excess", F.round(ll, 6).alias("ll"), F.round(ll0, 6).alias("ll_bg0"), "lo_all")


def choose_sets(scores: DataFrame, max_tags: int | None = 2, guides: bool = False, bg_phi: float = PHI_MAX) -> DataFrame:
    """Grow each cell's set until the score falls; LLR is best minus second best.

    ``guides`` lets any number join and adds the all-background model, under which the set is empty."""
    s = scores if max_tags is None else scores.filter(F.col("rank") <= max_tags)
    prev = F.lag("ll").over(W.partitionBy("barcode").orderBy("rank"))
    s = s.withColumn("fall", (prev.isNotNull() & (F.col("ll") < prev)).cast("int"))
    s = s.withColumn("falls", F.sum("fall").over(W.partitionBy("barcode").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    seen = (F.col("falls") == 0) | ((F.col("falls") == 1) & (F.col("fall") == 1))  # the first worse score is the runner-up
    g = s.filter(seen).groupBy("barcode").agg(
        F.array_sort(F.collect_list(F.when(F.col("falls") == 0, F.struct("rank", "tag", "ll")))).alias("in_"),
        F.max(F.when(F.col("falls") == 1, F.col("ll"))).alias("next_"),
        F.first("tot").cast("double").alias("tot"), F.first("ll_bg0").alias("ll_bg0"), F.first("lo_all").alias("lo_all"))
    best = F.element_at("in_", -1)["ll"]
    before = F.when(F.size("in_") > 1, F.get("in_", F.size("in_") - 2)["ll"])
    bg = F.round(F.col("ll_bg0") + nb_logpmf("tot", "lo_all", f"{bg_phi}D") / LN2, 6)
    second = F.greatest(before, F.col("next_"))  # NULLs are skipped
    second = F.greatest(second, bg) if guides else F.coalesce(second, bg)
    g = g.withColumn("best", best).withColumn("bg", bg).withColumn("second", second)
    names = F.array_sort(F.transform("in_", lambda z: z["tag"]))
    if not guides:
        return g.select("barcode", names.alias("tags"), F.round(F.col("best") - F.col("second"), 6).alias("llr"))
    empty = F.col("bg") > F.col("best")
    return g.select("barcode", F.when(empty, F.array().cast("array<string>")).otherwise(names).alias("tags"),
                    F.round(F.when(empty, F.col("bg") - F.col("best")).otherwise(F.col("best") - F.col("second")), 6).alias("llr"))


def label_rows(sets: DataFrame, guides: bool = False) -> DataFrame:
    """Assignment rows: sorted names joined; S/D/M by set size, or for guides the count and WT for none."""
    n = F.size("tags")
    if guides:
        return sets.select("barcode", F.when(n == 0, "WT").otherwise(F.array_join("tags", ",")).alias("id"), n.cast("string").alias("type"), "llr")
    return sets.filter(n > 0).select("barcode", F.array_join("tags", "+").alias("id"),
                                     F.when(n == 1, "S").when(n == 2, "D").otherwise("M").alias("type"), "llr")


def background_share(counts: DataFrame, fits: DataFrame, sets: DataFrame) -> DataFrame:
    """Most likely background share of each cell given its set; concave, so a grid and one finer grid suffice.

    Only the inside tags depend on the share other than through its logarithm."""
    s = ambient_shares(fits).select("tag", "bg", "hi")
    c = counts.join(s, "tag").join(sets.select("barcode", "tags"), "barcode")
    inside = F.array_contains("tags", F.col("tag"))
    g = c.groupBy("barcode").agg(F.sum(F.when(inside, 0).otherwise(F.col("cnt"))).alias("out"),
                                 F.sum(F.when(inside, F.col("hi")).otherwise(0.0)).alias("h"),
                                 F.collect_list(F.when(inside, F.struct("cnt", "bg", "hi"))).alias("in_"))

    def ll(c):
        return F.col("out") * F.log(c) + F.aggregate("in_", F.lit(0.0), lambda a, z: a + z["cnt"] * F.log(c * z["bg"] + (1 - c) * z["hi"] / F.col("h")))

    def best(grid):
        return F.array_max(F.transform(grid, lambda c: F.struct(F.round(ll(c), 9).alias("ll"), (-c).alias("c"))))["c"] * -1

    coarse = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda k: k / 100.0)
    g = g.withColumn("c0", best(coarse))
    fine = F.transform(F.sequence(F.lit(-19), F.lit(19)), lambda k: F.col("c0") + k / 2000.0)
    return g.withColumn("share", F.when(F.size("in_") == 0, F.lit(1.0)).otherwise(best(fine))).select("barcode", "share")


def ranked_totals(counts: DataFrame) -> DataFrame:
    """Total per tag with its rank; ``suspect`` marks an unnamed tag that outranks a named one."""
    t = counts.groupBy("tag", "name").agg(F.sum("cnt").alias("total"))
    w = W.orderBy(F.desc("total"), "tag")  # one row per tag of the panel
    worst = F.max(F.when(F.col("name").isNotNull(), F.col("rank"))).over(W.partitionBy())
    return t.withColumn("rank", F.row_number().over(w)).withColumn("suspect", F.col("name").isNull() & (F.col("rank") < worst))


def wide_counts(counts: DataFrame, names: list[str]) -> DataFrame:
    """One column per tag, zeros filled; the column names are given, so no extra pass finds them."""
    return counts.groupBy("barcode").pivot("tag", names).agg(F.sum("cnt")).fillna(0)


def membership(sets: DataFrame, names: list[str]) -> DataFrame:
    """0/1 per tag, columns in alphabetical order."""
    return sets.select("barcode", *[F.array_contains("tags", n).cast("int").alias(n) for n in sorted(names)])


def tag_names(df: DataFrame, limit: int = 10_000) -> list[str]:
    return sorted(x.tag for x in collect_bounded(df.select("tag").distinct(), limit))


def union_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Stack two wide tables on the union of their columns, missing ones zero."""
    return a.unionByName(b, allowMissingColumns=True).fillna(0)


def voted_offset(reads: DataFrame, tags: DataFrame, length: int) -> int:
    """The commonest place at which a tag occurs unchanged; reads with equal text are looked at once."""
    d = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    last = F.length("seq") - (length - 1)
    # an outer explode adds no filter that would be evaluated on every read below the grouping
    w = d.select("n", F.explode_outer(F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda p: F.struct(
        p.alias("pos"), F.substring(F.col("seq"), p, F.lit(length)).alias("text"))))).alias("w")).select("n", "w.pos", "w.text")
    votes = w.join(tags.select(F.col("seq").alias("text")), "text").groupBy("pos").agg(F.sum("n").alias("votes"))
    top = votes.agg(F.max_by("pos", F.struct("votes", (-F.col("pos")).alias("p"))).alias("pos")).first()
    return top.pos
