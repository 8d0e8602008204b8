"""Writers. Each returns what it wrote, read back with its schema, so a caller can check or go on from the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from poolcall.session import cut, fresh_path


def write_diagnostics(winner: DataFrame, runner_up: DataFrame) -> dict[str, DataFrame]:
    return {"winner": cut(winner), "runner_up": cut(runner_up)}


def write_assignments(labels: DataFrame, path: str, lib: str = "", style: str = "plain") -> None:
    """Four tab-separated columns without a header, the barcode decorated with its library."""
    from poolcall.functions.expr import format_barcode
    bc = format_barcode(F.col("barcode").cast("string"), F.lit(lib), style)
    labels.select(bc.alias("barcode"), "id", "type", "llr").write.csv(path, sep="\t")


def split_by_identity(reads: DataFrame, path: str) -> None:
    """One folder per identity, '+' written as 'x'. Rows of a large identity go to many files."""
    reads.withColumn("identity", F.translate("identity", "+", "x")).write.partitionBy("identity").parquet(path)


def write_pair_counts(pair_counts: DataFrame, lib: str, path: str) -> None:
    pair_counts.withColumn("library", F.lit(lib)).write.partitionBy("library").parquet(path)


def route_reads(reads: DataFrame, calls: DataFrame, path: str, kind: str = "rna", corrected: bool = True) -> None:
    """Reads of singlet cells into one folder per (species, kind, mate); '+' cells and unknown ones are left out.

    ``reads`` holds (read_id, barcode as read, corrected, mate, seq, qual)."""
    from poolcall.scaling import salted_join
    one = calls.filter("type = 'S'").select(F.col("barcode").alias("corrected"), F.col("id").alias("species"))
    r = salted_join(reads, one, ["corrected"], ["read_id"])
    if corrected:
        r = r.withColumn("barcode", F.col("corrected"))
    r.withColumn("kind", F.lit(kind)).write.partitionBy("species", "kind", "mate").parquet(path)


def preprocess_triplets(reads: DataFrame) -> DataFrame:
    """Read names carrying the corrected barcode as a comment, mates renumbered; barcode reads are gone."""
    return reads.select(F.concat(F.col("read_id").cast("string"), F.lit(" CB:Z:"), F.col("corrected")).alias("name"), "mate", "seq", "qual")


def write_variants(sites: DataFrame, path: str) -> None:
    """Tab-separated variant rows in (chrom, pos) order over range partitions, so the files follow one another."""
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), "info")
    d = sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    d.select(line.alias("value")).write.text(path)


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Number the distinct values of a column from 1 in order, over range partitions."""
    from poolcall.scaling import running_totals
    return running_totals(df.select(col).distinct(), [F.col(col)], {out: F.lit(1)})


def write_mex(mtx: DataFrame, path: str) -> None:
    """(barcode, feature, feature_type, cnt) as a barcodes/features/matrix triple, surviving rows renumbered densely."""
    rows = mtx.filter("cnt > 0")
    bc, ft = cut(dense_index(rows, "barcode", "bi")), cut(dense_index(rows, "feature", "fi"))
    types = rows.groupBy("feature").agg(F.max("feature_type").alias("feature_type"))
    # an axis list is its part files one after the other: no task holds the whole axis
    bc.repartitionByRange("bi").sortWithinPartitions("bi").select("barcode").write.text(f"{path}/barcodes")
    ft.join(types, "feature").repartitionByRange("fi").sortWithinPartitions("fi").select(
        F.concat_ws("\t", "feature", "feature", "feature_type")).write.text(f"{path}/features")
    body = rows.join(bc, "barcode").join(ft, "feature").select(F.concat_ws(" ", "fi", "bi", "cnt").alias("value"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bc.agg(F.count(F.lit(1)).alias("b")))).join(F.broadcast(ft.agg(F.count(F.lit(1)).alias("f"))))
    head = n.select(F.explode(F.array(F.lit("%%MatrixMarket matrix coordinate integer general"), F.concat_ws(" ", "f", "b", "n"))).alias("value"))
    head.coalesce(1).union(body).write.text(f"{path}/matrix")


def write_contamination(rates: DataFrame, profile: DataFrame, path: str) -> None:
    """Rate table by barcode over range partitions, and the profile (one row per member)."""
    rates.repartitionByRange("barcode").sortWithinPartitions("barcode").select("barcode", "c", "se").write.csv(f"{path}/contam_rate", sep="\t")
    profile.orderBy(F.desc("share")).select("sample", "share").write.csv(f"{path}/contam_prof", sep="\t")


def haplotype_texts(cons: DataFrame) -> DataFrame:
    """One 0/1/- text per cluster over its sites in order (a cluster has at most one row per site)."""
    g = cons.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "allele"))).alias("a"))
    return g.select("cluster", F.array_join(F.transform("a", lambda x: F.coalesce(x["allele"].cast("string"), F.lit("-"))), "").alias("hap"))


def haplotype_table(haps: DataFrame, sites: list[int]) -> DataFrame:
    """One column per site with 0, 1 or NA."""
    m = haps.groupBy("barcode").agg(F.map_from_entries(F.collect_list(F.struct("pos", "allele"))).alias("m"))
    return m.select("barcode", *[F.coalesce(F.col("m")[F.lit(s).cast("bigint")].cast("string"), F.lit("NA")).alias(f"s{s}") for s in sites])
