"""From alignment text to allele counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.operators import counts as C, pool as P
from poolcall.operators.pileup import site_alleles, usable
from poolcall.plans.fixtures import add_view
from poolcall.plans.registry import r, register, rq
from poolcall.plans.text_ingest import BLOCKS, put
from poolcall.sources import readers as R

MIN_MAPQ, MIN_BASEQ = 20, 20

# unknown bases in each sixth read, poor qualities in the second half of each fifth
add_view("fx_aligned", """
    SELECT read_id, name, flag, chrom, rstart, mapq, cigar, barcode, gene,
           CASE WHEN read_id % 6 = 0 THEN concat(substr(seq, 1, 7), 'N', substr(seq, 9)) ELSE seq END AS seq,
           CASE WHEN read_id % 5 = 0 THEN 'FFFFFFFFFF##########' ELSE 'FFFFFFFFFFFFFFFFFFFF' END AS qual FROM fx_aln""")


def _alleles(fx):
    row = F.concat_ws("\t", "name", "flag", "chrom", "rstart", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual",
                      F.when(F.col("barcode") % 9 != 0, F.concat(F.lit("CB:Z:C"), F.col("barcode"))),
                      F.concat(F.lit("GX:Z:G"), F.col("gene"), F.lit(";G"), F.col("gene") + 1))
    reads = R.read_sam(fx.spark, put(fx.fx_aligned.select(row.alias("value")), "sam"))
    return site_alleles(usable(reads, MIN_MAPQ).filter("barcode IS NOT NULL"), fx.fx_sites, MIN_BASEQ).select("barcode", "site_id", "mapq", "gene_ids", "is_alt")


WEIGHT = "CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT)"
add_view("fx_alleles", f"""
    SELECT concat('C', CAST(barcode AS VARCHAR)) AS barcode, site_id, {WEIGHT} AS w, gene, CASE base WHEN ref THEN 0 WHEN alt THEN 1 ELSE 2 END AS is_alt FROM (
      SELECT a.barcode, a.mapq, a.gene, s.site_id, s.ref, s.alt, substr(a.seq, CAST(b.q + s.pos - a.rstart - b.r + 1 AS BIGINT), 1) AS base,
             substr(a.qual, CAST(b.q + s.pos - a.rstart - b.r + 1 AS BIGINT), 1) AS bq
      FROM fx_aligned a JOIN (VALUES {", ".join(map(str, BLOCKS))}) b(c, r, q, n) ON b.c = a.cigar
      JOIN fx_sites s ON s.chrom = a.chrom AND s.pos >= a.rstart + b.r AND s.pos < a.rstart + b.r + b.n
      WHERE (a.flag & 1024) = 0 AND a.mapq >= {MIN_MAPQ} AND a.barcode % 9 <> 0) x WHERE base <> 'N' AND bq <> '#'""", _alleles)


def _sums(*alleles) -> str:
    return ", ".join(f"CAST(coalesce(sum(w) FILTER (WHERE is_alt = {k}), 0) AS BIGINT) AS {n}" for k, n in alleles)


BULK = f"SELECT site_id, {_sums((0, 'ref_w'), (1, 'alt_w'), (2, 'other_w'))} FROM fx_alleles GROUP BY site_id"


@register("e1_counts_from_alignments", f"""
    SELECT barcode, site_id, {_sums((0, "ref_w"), (1, "alt_w"))} FROM fx_alleles WHERE is_alt < 2 GROUP BY barcode, site_id""")
def e1_alignments(fx):
    return C.cell_site_counts(fx.fx_alleles).select("barcode", "site_id", "ref_w", "alt_w")


@register("e2_bulk_from_alignments", f"""
    SELECT b.*, g.genes FROM ({BULK}) b JOIN (
      SELECT site_id, array_to_string(list_sort(list(DISTINCT concat('G', CAST(gene + d AS VARCHAR)))), ',') AS genes
      FROM fx_alleles, (VALUES (0), (1)) v(d) GROUP BY site_id) g ON g.site_id = b.site_id""")
def e2_alignments(fx):
    return C.bulk_site_counts(fx.fx_alleles, genes="gene_ids").withColumn("genes", F.array_join("genes", ","))


@register("e25_rate_from_alignments", f"""
    SELECT {rq('greatest(avg(CAST(other_w AS DOUBLE) / (ref_w + alt_w + other_w)), 0.001)', 6)} AS rate FROM ({BULK}) q WHERE ref_w + alt_w + other_w > 0""")
def e25_alignments(fx):
    bulk = C.bulk_site_counts(fx.fx_alleles, genes="gene_ids")
    return P.other_allele_rate(bulk.select("site_id", F.col("ref_w").alias("ref"), F.col("alt_w").alias("alt"), F.col("other_w").alias("err"))).select(r("rate", 6).alias("rate"))
