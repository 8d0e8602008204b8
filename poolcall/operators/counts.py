"""Allele, tag and pair counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from poolcall.functions.expr import micro, phred_weight


def cell_site_counts(pileup: DataFrame) -> DataFrame:
    """Weighted ref and alt per (barcode, site) in integer millionths; other alleles do not count."""
    w = micro(phred_weight("mapq"))
    return pileup.filter("is_alt < 2").groupBy("barcode", "site_id").agg(
        F.sum(F.when(F.col("is_alt") == 0, w).otherwise(0)).alias("ref_w"),
        F.sum(F.when(F.col("is_alt") == 1, w).otherwise(0)).alias("alt_w"))


def site_calls(genotypes: DataFrame) -> DataFrame:
    """One row per site: its called members as a sorted array (as long as the pool is large)."""
    return genotypes.groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.struct("sample", "nalt"))).alias("calls"))


def pattern_ids(genotypes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site_id, pattern_id) and the dictionary (pattern_id, calls): sites with the same calls share a pattern, named
    after its smallest site. Only this step compares the calls themselves; later shuffles carry the id."""
    sites = site_calls(genotypes)
    patterns = sites.groupBy("calls").agg(F.min("site_id").alias("pattern_id"))
    return sites.join(patterns, "calls").select("site_id", "pattern_id"), patterns.select("pattern_id", "calls")


def cell_patterns(cell_site: DataFrame, genotypes: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """Counts per (barcode, genotype pattern): sites with one pattern are alike to every later step.

    Grouped by (barcode, pattern_id); the calls are looked up in the dictionary once the counts are summed."""
    ids, patterns = pattern_ids(genotypes)
    per = (cell_site.join(ids, "site_id").groupBy("barcode", "pattern_id")
           .agg(F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w"),
                *[c.alias(n) for n, c in (more or {}).items()]))
    return per.join(patterns, "pattern_id")


def pair_sites(genotypes: DataFrame) -> DataFrame:
    """Number of sites per (i, j, ni, nj), i < j. Sites collapse to patterns first, so the pairs are
    expanded once per distinct pattern."""
    pat = site_calls(genotypes).groupBy("calls").agg(F.count(F.lit(1)).alias("n"))
    return (pat.select("n", F.explode(_classes(F.col("calls"))).alias("c")).filter("c.j >= 0")
            .groupBy("c.i", "c.j", "c.ni", "c.nj").agg(F.sum("n").alias("sites")))


def assigned_het_variance(cell_site: DataFrame, genotypes: DataFrame, calls: DataFrame) -> DataFrame:
    """Mean and variance of the alt fraction over het sites of the cell's own members."""
    f = cell_site.select("barcode", "site_id", (F.col("alt_w") / (F.col("ref_w") + F.col("alt_w"))).alias("f"))
    het = genotypes.filter("nalt = 1").groupBy("site_id").agg(F.collect_list("sample").alias("hets"))  # at most the pool
    own = F.array_distinct(F.array("i", "j"))
    hits = f.join(calls.select("barcode", "i", "j"), "barcode").join(het, "site_id").select(
        "barcode", "i", "j", "f", F.explode(F.array_intersect(own, "hets")))
    return hits.groupBy("barcode", "i", "j").agg(
        F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean"), F.var_samp("f").alias("var"))


def _classes(calls: Column) -> Column:
    """Totals (j = nj = -1) and classes i < j of one pattern."""
    def cls(i, ni, j, nj):
        return F.struct(i.alias("i"), ni.alias("ni"), j.alias("j"), nj.alias("nj"))
    totals = F.transform(calls, lambda x: cls(x["sample"], x["nalt"], F.lit(-1), F.lit(-1)))
    pairs = F.flatten(F.transform(calls, lambda x: F.transform(
        F.filter(calls, lambda y: y["sample"] > x["sample"]),
        lambda y: cls(x["sample"], x["nalt"], y["sample"], y["nalt"]))))
    return F.concat(totals, pairs)


def pair_counts(cell_site: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Pair-class counts (barcode, i, ni, j, nj) with totals at j = nj = -1.

    Sites collapse to genotype patterns per cell before classes are expanded, so the expansion works on
    (cell, pattern) rows instead of (cell, site) rows; class sums combine before the second shuffle."""
    return expand_classes(cell_patterns(cell_site, genotypes))


def expand_classes(patterns: DataFrame) -> DataFrame:
    """Pair-class counts of (barcode, ref_w, alt_w, calls) rows."""
    return (patterns.select("barcode", "ref_w", "alt_w", F.explode(_classes(F.col("calls"))).alias("c"))
            .groupBy("barcode", "c.i", "c.ni", "c.j", "c.nj")
            .agg(F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w")))


def conditional_fractions(genotypes: DataFrame) -> DataFrame:
    """Mean alt fraction of member j over the sites where member i has ni alt copies.

    Counted on genotype patterns, both directions at once; the self rows are exact."""
    pat = site_calls(genotypes).groupBy("calls").agg(F.count(F.lit(1)).alias("n"))
    cls = F.flatten(F.transform(F.col("calls"), lambda x: F.transform(
        F.filter(F.col("calls"), lambda y: y["sample"] != x["sample"]),
        lambda y: F.struct(x["sample"].alias("i"), x["nalt"].alias("ni"), y["sample"].alias("j"), y["nalt"].alias("nj")))))
    others = (pat.select("n", F.explode(cls).alias("c")).groupBy("c.i", "c.ni", "c.j")
              .agg((F.sum(F.col("n") * F.col("c.nj")) / F.sum("n") / 2).alias("frac")))
    own = (pat.select(F.explode("calls").alias("c")).select("c.sample", "c.nalt").distinct()
           .select(F.col("sample").alias("i"), F.col("nalt").alias("ni"), F.col("sample").alias("j"),
                   (F.col("nalt") / 2).alias("frac")))
    return others.unionByName(own)


def bulk_site_counts(pileup: DataFrame, genes: str = "gene") -> DataFrame:
    """Ref, alt and other alleles per site over all cells, and the genes of the reads there (a column of one gene or of lists).

    Genes are first made distinct per site, so the set is no longer than the gene list."""
    w = micro(phred_weight("mapq"))
    found = F.collect_set(genes)
    if isinstance(pileup.schema[genes].dataType, ArrayType):
        found = F.array_distinct(F.flatten(found))
    return pileup.groupBy("site_id").agg(
        F.sum(F.when(F.col("is_alt") == 0, w).otherwise(0)).alias("ref_w"),
        F.sum(F.when(F.col("is_alt") == 1, w).otherwise(0)).alias("alt_w"),
        F.sum(F.when(F.col("is_alt") == 2, w).otherwise(0)).alias("other_w"),
        F.array_sort(found).alias("genes"))


def identity_site_counts(cell_site: DataFrame, assigned: DataFrame) -> DataFrame:
    """Ref and alt per (identity, site)."""
    return (cell_site.join(assigned.select("barcode", "i", "j"), "barcode").groupBy("i", "j", "site_id")
            .agg(F.sum("ref_w").alias("ref_w"), F.sum("alt_w").alias("alt_w")))


def het_balance(pileup: DataFrame, genotypes: DataFrame) -> DataFrame:
    """Mean and variance over het sites of the per-site alt fraction, per (barcode, member)."""
    site = cell_site_counts(pileup).withColumn("f", F.col("alt_w") / (F.col("ref_w") + F.col("alt_w")))
    het = genotypes.filter("nalt = 1").select("site_id", "sample")
    return (site.join(het, "site_id").groupBy("barcode", "sample")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("f").alias("mean"), F.var_samp("f").alias("var")))


def umi_counts(reads: DataFrame) -> DataFrame:
    """Distinct UMIs per (barcode, tag). Deduplicates on all three keys first, so a hot cell is spread."""
    return reads.select("barcode", "tag", "umi").distinct().groupBy("barcode", "tag").agg(F.count(F.lit(1)).alias("cnt"))


def umi_counts_approx(reads: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Sketch form of :func:`umi_counts` for totals over very many UMIs.

    A sketch starts as a list of its UMIs, so the many groups with few of them take little room; one of 2^k registers has a
    relative error of 1.04 / 2^(k/2)."""
    k = min(max(math.ceil(2 * math.log2(1.04 / rsd)), 4), 21)
    umi = F.when(F.col("umi").isNotNull(), F.xxhash64("umi"))  # as they are, empty texts would not count
    g = reads.groupBy("barcode", "tag").agg(F.hll_sketch_agg(umi, k).alias("s_"))
    return g.select("barcode", "tag", F.hll_sketch_estimate("s_").alias("cnt"))
