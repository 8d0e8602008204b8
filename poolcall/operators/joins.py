"""Range, interval and fuzzy joins as binned or seeded equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.functions.expr import hamming
from poolcall.scaling import salted_join

BIN = 128  # positions per bin; a little above the usual read span


def range_join(reads: DataFrame, sites: DataFrame, bin_size: int = BIN, salt_by: list[str] | None = None) -> DataFrame:
    """Pairs of reads and sites with ``rstart <= pos <= rend`` on one chromosome.

    Both sides are cut into bins, so it is an equi join on (chrom, bin). A read is repeated once per bin it
    spans; a (read, site) pair meets in exactly one bin, so nothing is found twice. With ``salt_by`` the bins
    holding a large share of the reads are spread over many tasks."""
    lo, hi = F.floor(F.col("rstart") / bin_size), F.floor(F.col("rend") / bin_size)
    a = reads.withColumn("bin_", F.explode(F.sequence(lo, hi)))
    b = sites.withColumn("bin_", F.floor(F.col("pos") / bin_size))
    j = salted_join(a, b, ["chrom", "bin_"], salt_by) if salt_by else a.join(b, ["chrom", "bin_"])
    return j.filter((F.col("pos") >= F.col("rstart")) & (F.col("pos") <= F.col("rend"))).drop("bin_")


def interval_lookup(points: DataFrame, intervals: DataFrame, key: str, score: Column, default: float,
                    out: str, bin_size: int = 1024) -> DataFrame:
    """Best score of the intervals (start <= pos < end) around each point, or ``default``.

    Intervals of any length and nesting count: each is repeated over its bins, and the best score is taken
    inside the shuffle that groups hits by point."""
    iv = intervals.select("chrom", "start", "end", score.alias("s_")).withColumn(
        "bin_", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size))))
    hits = (points.select(key, "chrom", "pos", F.floor(F.col("pos") / bin_size).alias("bin_"))
            .join(iv, ["chrom", "bin_"])
            .filter((F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end")))
            .groupBy(key).agg(F.max("s_").alias("s_")))
    return points.join(hits, key, "left").withColumn(out, F.coalesce("s_", F.lit(default))).drop("s_")


def one_place_masked(seq: Column) -> Column:
    """The text with each place in turn masked, as an array: texts of one length share a mask if they differ there alone."""
    return F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.overlay(seq, F.lit("*"), i))


def match_allow_list(reads: DataFrame, allow: DataFrame, col: str = "barcode") -> DataFrame:
    """Correct ``col`` against an allow-list: exact match first, else a unique entry one mismatch away.

    Work is per distinct observed text (counts of reads collapse first), then joined back. Observed texts that missed
    meet the entries that share one of their masks: as many rows a text as it has places, of either side."""
    seen = reads.select(col).distinct()
    exact = seen.join(allow.select(F.col(col), F.col(col).alias("hit_")), col, "left")
    def masked(d, *own):
        return d.filter(F.length(col) > 0).select(*own, F.explode(one_place_masked(F.col(col))).alias("m_"))

    near = (masked(exact.filter("hit_ IS NULL"), col).join(masked(allow, F.col(col).alias("n_")), "m_")
            .groupBy(col).agg(F.count(F.lit(1)).alias("k_"), F.min("n_").alias("near_")).filter("k_ = 1"))
    fixed = exact.join(near.select(col, "near_"), col, "left").select(
        col, F.coalesce("hit_", "near_").alias("corrected"),
        F.when(F.col("hit_").isNotNull(), 0).when(F.col("near_").isNotNull(), 1).alias("mismatches"))
    return reads.join(fixed.filter("corrected IS NOT NULL"), col)


def pieces(seq: Column, length: int, n: int) -> Column:
    """The text in ``n`` consecutive pieces as STRUCT<part, text>: with fewer than n mismatches one is intact."""
    cuts = [round(k * length / n) for k in range(n + 1)]
    return F.array(*[F.struct(F.lit(k).alias("part"), F.substring(seq, cuts[k] + 1, cuts[k + 1] - cuts[k]).alias("text"))
                     for k in range(n)])


def match_tags(windows: DataFrame, tags: DataFrame, length: int, max_mm: int = 2) -> DataFrame:
    """Best tag within ``max_mm`` mismatches of the text ``window``; ties give no match.

    Seeded: both sides are cut into max_mm + 1 pieces and at least one piece must agree, so the candidates come
    from an equi join on (part, text). Works on distinct windows, then joins back."""
    d = windows.select("window").distinct()
    a = d.withColumn("p_", F.explode(pieces(F.col("window"), length, max_mm + 1))).select("window", "p_.part", "p_.text")
    b = tags.withColumn("p_", F.explode(pieces(F.col("seq"), length, max_mm + 1))).select("tag", "seq", "p_.part", "p_.text")
    cand = a.join(b, ["part", "text"]).select("window", "tag", "seq").distinct()
    scored = cand.withColumn("mm", hamming("window", "seq")).filter(F.col("mm") <= max_mm)
    best = scored.groupBy("window").agg(F.min_by("tag", "mm").alias("tag"), F.min("mm").alias("mm"),
                                        F.array_sort(F.collect_list("mm")).alias("all_"))
    # collect_list is bounded by the number of tags within max_mm of one text
    unique = best.filter((F.size("all_") == 1) | (F.col("all_")[0] < F.get(F.col("all_"), F.lit(1))))
    return windows.join(unique.select("window", "tag", "mm"), "window")
