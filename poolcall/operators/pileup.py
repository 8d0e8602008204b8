"""From alignments to the allele that each read shows at each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from poolcall.operators.joins import range_join
from poolcall.sources.readers import placed_blocks

UNUSABLE = 4 + 256 + 512 + 1024 + 2048  # flag bits: unmapped, secondary, failed, duplicate, supplementary
REF, ALT, OTHER = 0, 1, 2


def usable(alignments: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Mapped primary alignments that are no duplicates, passed the machine's checks and map well enough."""
    return alignments.filter((F.col("flag").bitwiseAND(UNUSABLE) == 0) & (F.col("chrom") != "*") & (F.col("cigar") != "*") & (F.col("mapq") >= min_mapq))


def site_alleles(alignments: DataFrame, sites: DataFrame, min_baseq: int = 0) -> DataFrame:
    """``alignments(chrom, rstart, cigar, seq, qual, ...)`` at ``sites(site_id, chrom, pos, ref, alt)``: a row per read and site.

    The placed blocks of a read, not its whole span, meet the sites, so introns, deletions, insertions and clipped bases
    give none; each block carries its own bases only. ``is_alt`` is 0 for ref, 1 for alt and 2 for another base; bases
    other than A, C, G, T and those under ``min_baseq`` are left out (a quality of ``*`` is unknown and passes)."""
    keep = [c for c in alignments.columns if c not in ("chrom", "rstart", "rend", "cigar", "seq", "qual")]
    qual = F.when(F.col("qual") != "*", F.col("qual"))
    b = placed_blocks(alignments.withColumn("qual", qual)).select(*keep, "chrom", "seq", "qual", F.explode("blocks").alias("b"))
    part = lambda c: F.substring(F.col(c), (F.col("b.q") + 1).cast("int"), F.col("b.n").cast("int"))
    b = b.select(*keep, "chrom", F.col("b.r").alias("rstart"), (F.col("b.r") + F.col("b.n") - 1).alias("rend"), part("seq").alias("seq"), part("qual").alias("qual"))
    at = (F.col("pos") - F.col("rstart") + 1).cast("int")
    hit = range_join(b, sites.select("site_id", "chrom", "pos", "ref", "alt")).select(
        *keep, "site_id", "ref", "alt", F.upper(F.substring(F.col("seq"), at, F.lit(1))).alias("base"), F.substring(F.col("qual"), at, F.lit(1)).alias("bq"))
    hit = hit.filter(F.col("base").isin("A", "C", "G", "T") & (F.col("bq").isNull() | (F.ascii("bq") - 33 >= min_baseq)))
    allele = F.when(F.col("base") == F.col("ref"), REF).when(F.col("base") == F.col("alt"), ALT).otherwise(OTHER)
    return hit.select(*keep, "site_id", allele.alias("is_alt"))
