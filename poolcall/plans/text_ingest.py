"""Readers over text that Spark writes from the tables, and sparse-matrix reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from poolcall.functions.expr import pin
from poolcall.plans.fixtures import SPARK_FORMS, acgt, add_view
from poolcall.plans.registry import r, register, rq
from poolcall.session import fresh_path
from poolcall.sources import readers as R, sinks


def put(df, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.text(path)
    return path


# --- variants ---------------------------------------------------------------------------------------

def _vcf(fx) -> str:
    """Repeated positions, indels and low qualities are among the records."""
    g = fx.fx_genotypes.groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "nalt"))).alias("m"))
    gt = [F.coalesce(F.when(F.col("m")[k] == 0, "0/0").when(F.col("m")[k] == 1, "0|1").when(F.col("m")[k] == 2, "1/1"), F.lit("./.")) for k in range(5)]
    d = fx.fx_sites.join(g, "site_id", "left").withColumn("alt", F.when(F.col("site_id") % 23 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")))
    row = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), F.lit("."), F.lit("GT:DP"),
                      *[F.concat(x, F.lit(":9")) for x in gt])
    body = d.select(F.explode(F.when(F.col("site_id") % 29 == 0, F.array(row, row)).otherwise(F.array(row))).alias("value"))
    head = fx.spark.range(1).select(F.explode(F.array(F.lit("##fileformat=VCFv4.2"), F.lit("\t".join(
        ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "A", "B", "C", "D", "E"])))).alias("value"))
    return put(head.union(body), "vcf")


KEPT = "SELECT * FROM fx_sites WHERE qual >= 20 AND site_id % 23 <> 0 AND site_id % 29 <> 0 AND ref <> alt"


@register("a1_read_vcf_genotypes", f"""
    SELECT s.chrom, s.pos, CAST(g.sample AS INT) AS sample, g.nalt FROM ({KEPT}) s JOIN fx_genotypes g ON g.site_id = s.site_id""")
def a1(fx):
    return R.read_vcf(fx.spark, _vcf(fx), 20)[1].select("chrom", "pos", "sample", "nalt")


@register("a1_read_vcf_sites", f"""
    SELECT row_number() OVER (ORDER BY chrom, pos) AS site_id, chrom, pos, ref, alt FROM ({KEPT}) s
    WHERE site_id IN (SELECT site_id FROM fx_genotypes GROUP BY site_id HAVING count(*) = 5)""")
def a1s(fx):
    return R.number_sites(R.read_vcf(fx.spark, _vcf(fx), 20, allow_missing=False)[0]).select("site_id", "chrom", "pos", "ref", "alt")


# --- alignments -------------------------------------------------------------------------------------

CIGARS = ["20M", "3S17M", "8M2I10M", "9M5D11M", "6M100N14M", "4H20M", "10M10S"]
CIGAR = "CASE l_linenumber " + " ".join(f"WHEN {k + 1} THEN '{c}'" for k, c in enumerate(CIGARS)) + " END"
_TAIL = acgt("(read_id * 48271 + 11) % 2147483647", 15)
ALN_SEQ = _TAIL.replace("concat(", "concat('ACGTA', ", 1)
SPARK_FORMS[ALN_SEQ] = f"concat('ACGTA', {SPARK_FORMS[_TAIL]})"
add_view("fx_aln", f"""
    SELECT read_id, concat('r', CAST(read_id AS STRING)) AS name, flag, chrom, rstart + 1000 AS rstart, mapq, {CIGAR} AS cigar,
           {ALN_SEQ} AS seq, barcode, gene FROM fx_reads""")


def _sam(fx) -> str:
    row = F.concat_ws("\t", "name", "flag", "chrom", F.col("rstart").cast("string"), "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.lit("*"),
                      F.concat(F.lit("NH:i:1\tUB:Z:U"), F.col("read_id") % 7),
                      F.when(F.col("barcode") % 9 != 0, F.concat(F.lit("CB:Z:C"), F.col("barcode"))),
                      F.concat(F.lit("GX:Z:G"), F.col("gene"), F.lit(";G"), F.col("gene") + 1))
    return put(fx.fx_aln.select(row.alias("value")), "sam")


SPANS = "CASE cigar " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in zip(CIGARS, (20, 17, 18, 25, 120, 20, 10))) + " END"


@register("a2_read_sam", f"""
    SELECT name, flag, chrom, rstart, rstart + {SPANS} - 1 AS rend, mapq, CASE WHEN barcode % 9 <> 0 THEN concat('C', CAST(barcode AS VARCHAR)) END AS barcode,
           concat('U', CAST(read_id % 7 AS VARCHAR)) AS umi, concat('G', CAST(gene AS VARCHAR), ',G', CAST(gene + 1 AS VARCHAR)) AS genes FROM fx_aln""")
def a2(fx):
    return R.read_sam(fx.spark, _sam(fx)).select("name", "flag", "chrom", "rstart", "rend", "mapq", "barcode", "umi", F.array_join("gene_ids", ",").alias("genes"))


# reference offset, read offset and length of each placed block
BLOCKS = [("20M", 0, 0, 20), ("3S17M", 0, 3, 17), ("8M2I10M", 0, 0, 8), ("8M2I10M", 8, 10, 10), ("9M5D11M", 0, 0, 9), ("9M5D11M", 14, 9, 11),
          ("6M100N14M", 0, 0, 6), ("6M100N14M", 106, 6, 14), ("4H20M", 0, 0, 20), ("10M10S", 0, 0, 10)]


@register("a3_aligned_bases", f"""
    SELECT chrom, pos, base, count(*) AS n FROM (
      SELECT chrom, rstart + b.r + i AS pos, substr(seq, CAST(b.q + i + 1 AS BIGINT), 1) AS base FROM fx_aln JOIN (VALUES {", ".join(map(str, BLOCKS))}) b(c, r, q, n) ON b.c = cigar,
      LATERAL (SELECT unnest(range(0, b.n)) AS i) z) q GROUP BY chrom, pos, base""")
def a3(fx):
    return R.base_counts(fx.fx_aln)


READS_PER_CHUNK = 50_000


@register("a4_read_fastq", """
    SELECT name AS read_id, seq AS seq1, repeat('F', length(seq)) AS qual1, reverse(seq) AS seq2, repeat('#', length(seq)) AS qual2,
           substr(seq, 1, 8) AS seq3, repeat(':', 8) AS qual3 FROM fx_aln""")
def a4(fx):
    """Three mates written to three or more chunk files each, in one order, read back and paired by chunk and record."""
    chunks = max(3, fx.lineitem.count() // READS_PER_CHUNK)
    order = fx.fx_reads.select("read_id", F.pmod(F.col("read_id"), F.lit(chunks)).alias("chunk"))
    order = order.repartition("chunk").sortWithinPartitions("chunk", "read_id")  # numbers alone are moved; texts are made in place

    def written(mate, seq, q):
        rows = pin(order.withColumn("name", F.expr("concat('r', read_id)")), seq=F.expr(SPARK_FORMS[ALN_SEQ]))
        record = F.concat(F.lit("@"), "name", F.lit(f"/{mate}\n"), seq, F.lit("\n+\n"), F.repeat(F.lit(q), F.length(seq)))
        path = fresh_path(fx.spark, f"fq{mate}")
        rows.select("chunk", record.alias("value")).write.partitionBy("chunk").text(path, compression="gzip")
        return path

    return R.read_mates(fx.spark, written(1, F.col("seq"), "F"), written(2, F.reverse("seq"), "#"), written(3, F.substring("seq", 1, 8), ":"))


# --- matrices ----------------------------------------------------------------------------------------

TYPE = "CASE WHEN gene % 10 = 0 THEN 'Antibody Capture' ELSE 'Gene Expression' END"
add_view("fx_matrix", f"SELECT {acgt('barcode * 77747 + 13', 16)} AS barcode, concat('g', CAST(gene AS STRING)) AS feature, {TYPE} AS feature_type, cnt FROM fx_mtx")


@register("a5_read_mex", "SELECT barcode, feature, cnt FROM fx_matrix WHERE feature_type = 'Gene Expression'")
def a5(fx):
    path = fresh_path(fx.spark, "mex")
    sinks.write_mex(fx.fx_matrix, path)
    return R.read_mex(fx.spark, path, "Gene Expression").select("barcode", "feature", "cnt")


@register("b6_write_mex", """
    SELECT dense_rank() OVER (ORDER BY feature) AS fi, dense_rank() OVER (ORDER BY barcode) AS bi, cnt FROM fx_matrix WHERE cnt > 20""")
def b6(fx):
    path = fresh_path(fx.spark, "mex")
    sinks.write_mex(fx.fx_matrix.filter("cnt > 20"), path)
    p = F.split("value", " ")
    lines = R.text_lines(fx.spark, f"{path}/matrix")
    head = lines.filter(F.col("value").startswith("%")).select("file", (F.col("idx") + 1).alias("idx"))
    return lines.filter(~F.col("value").startswith("%")).join(head, ["file", "idx"], "left_anti").select(
        p[0].cast("bigint").alias("fi"), p[1].cast("bigint").alias("bi"), p[2].cast("bigint").alias("cnt"))


@register("c16_matrix_subset", """
    SELECT dense_rank() OVER (ORDER BY feature) AS fi, dense_rank() OVER (ORDER BY barcode) AS bi, cnt FROM fx_matrix
    WHERE feature_type = 'Antibody Capture' AND barcode IN (SELECT barcode FROM fx_allow WHERE cell % 3 <> 0)""")
def c16(fx):
    m = fx.fx_matrix.filter("feature_type = 'Antibody Capture'").join(fx.fx_allow.filter("cell % 3 <> 0").select("barcode"), "barcode", "left_semi")
    return m.join(sinks.dense_index(m, "feature", "fi"), "feature").join(sinks.dense_index(m, "barcode", "bi"), "barcode").select(
        F.col("fi").cast("bigint").alias("fi"), F.col("bi").cast("bigint").alias("bi"), "cnt")


DECOR = "CASE WHEN cnt % 2 = 0 THEN concat('L', CAST(cnt % 3 AS STRING), '_', barcode) ELSE concat(barcode, '-1-L', CAST(cnt % 3 AS STRING)) END"


@register("c17_split_libraries", "SELECT concat('L', CAST(cnt % 3 AS VARCHAR)) AS library, barcode, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS total FROM fx_matrix GROUP BY 1, 2")
def c17(fx):
    d = R.split_libraries(fx.fx_matrix.withColumn("barcode", F.expr(DECOR)))
    return d.groupBy("library", "barcode").agg(F.count(F.lit(1)).alias("n"), F.sum("cnt").alias("total"))


@register("c11_skip_genes", """
    SELECT barcode, CAST(sum(cnt) AS BIGINT) AS total FROM fx_matrix WHERE NOT regexp_matches(feature, '^g1') AND feature NOT IN (SELECT concat('g', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 40)
    GROUP BY barcode""")
def c11(fx):
    skip = fx.part.filter("p_size > 40").select(F.concat(F.lit("g"), F.col("p_partkey").cast("string")).alias("feature"))
    d = fx.fx_matrix.filter(~F.col("feature").rlike("^g1")).join(skip, "feature", "left_anti")
    return d.groupBy("barcode").agg(F.sum("cnt").alias("total"))


# --- small text tables ---------------------------------------------------------------------------------

@register("a6_read_assignments", "SELECT CAST(barcode AS VARCHAR) AS barcode, id, type, llr FROM fx_labels_a WHERE llr > 30 AND type = 'S'")
def a6(fx):
    path = fresh_path(fx.spark, "assignments")
    sinks.write_assignments(fx.fx_labels_a, path, style="one")
    return R.read_assignments(fx.spark, path, 30, keep_doublets=False)


@register("a9_read_gtf", """
    SELECT chrom, CASE WHEN start % 3 = 0 THEN 'gene' ELSE 'exon' END AS feature, start, stop AS "end" FROM fx_genes WHERE start % 3 < 2""")
def a9(fx):
    kind = F.when(F.col("start") % 3 == 0, "gene").when(F.col("start") % 3 == 1, "exon").otherwise("CDS")
    row = F.concat_ws("\t", "chrom", F.lit("src"), kind, (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit(".\t+\t.\tgene_id \"x\""))
    return R.read_gtf(fx.spark, put(fx.fx_genes.select(row.alias("value")), "gtf"))


@register("a10_read_bedgraph", """SELECT chrom, start, stop AS "end", score FROM fx_coverage""")
def a10(fx):
    return R.read_bedgraph(fx.spark, put(fx.fx_coverage.select(F.concat_ws("\t", "chrom", "start", "stop", "score").alias("value")), "bedgraph"))


@register("a11_read_maps", """
    SELECT s.seq, s.tag AS well, n.n_name AS name FROM fx_tag_seqs s JOIN nation n ON s.tag = concat('N', CAST(n.n_nationkey AS VARCHAR))""")
def a11(fx):
    a = put(fx.fx_tag_seqs.select(F.concat_ws("\t", "seq", "tag").alias("value")), "wells")
    b = put(fx.nation.select(F.concat_ws("\t", F.concat(F.lit("N"), "n_nationkey"), "n_name").alias("value")), "names")
    return R.read_map(fx.spark, a, "seq", "well").join(R.read_map(fx.spark, b, "well", "name"), "well").select("seq", "well", "name")


@register("a13_read_props", f"SELECT member, {rq('share', 6)} AS share FROM fx_comp_a")
def a13(fx):
    path = fresh_path(fx.spark, "props")
    sinks.write_assignments(fx.fx_labels_a, path)
    return R.read_props(fx.spark, path).select("member", r("share", 6).alias("share"))
