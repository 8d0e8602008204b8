"""Readers for the text and table forms the engine takes in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from poolcall.scaling import hot_keys


def read_pair_counts(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """Stored pair-class counts, optionally only of allowed members (rows of totals keep j = -1)."""
    p = spark.read.parquet(path)
    if allowed is None:
        return p
    a = allowed.select(F.col("sample").alias("i"))
    b = allowed.select(F.col("sample").alias("j")).union(spark.range(1).select(F.lit(-1)))
    return p.join(a, "i", "left_semi").join(b, "j", "left_semi")


def read_counts_wide(spark: SparkSession, path: str) -> DataFrame:
    """Header-named count table to long rows; a repeated column name is an error, zeros are dropped.

    The header is read as text, since the csv reader would rename repeats."""
    head = spark.read.text(path).limit(1).first()
    names = head.value.split("\t")
    if len(set(names)) != len(names):
        raise ValueError(f"repeated column names in {path}")
    schema = ", ".join(f"`{n}` {'STRING' if k == 0 else 'BIGINT'}" for k, n in enumerate(names))
    wide = spark.read.schema(schema).csv(path, sep="\t", header=True)
    return wide.unpivot([names[0]], names[1:], "tag", "cnt").filter("cnt > 0").withColumnRenamed(names[0], "barcode")


def text_lines(spark: SparkSession, path: str, one_list: bool = False) -> DataFrame:
    """Lines with their 1-based number inside their file: (file, idx, value). With ``one_list`` the files of a folder, by
    name, are one list and numbered through.

    A task numbers the lines of each split it reads; the table of lines per split (small) gives the number
    of lines before it in the file. Nothing is sorted and files are read in parallel splits."""
    off = split_starts(spark, path, one_list)
    return split_lines(spark, path).join(off, ["file", "b_"]).select("file", (F.col("m_") - F.col("f_") + F.col("o_") + 1).alias("idx"), "value")


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, b_, m_): lines with the start of their split and a number that rises within it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("b_"),
                                        F.monotonically_increasing_id().alias("m_"))


def split_starts(spark: SparkSession, path: str, one_list: bool = False) -> DataFrame:
    """(file, b_, f_, o_): first number of each split and the lines before it, of its file or, with ``one_list``, of the folder."""
    per = split_lines(spark, path).groupBy("file", "b_").agg(F.count(F.lit(1)).alias("n_"), F.min("m_").alias("f_"))
    before = (W.orderBy("file", "b_") if one_list else W.partitionBy("file").orderBy("b_")).rowsBetween(W.unboundedPreceding, -1)  # one row per split
    return per.select("file", "b_", "f_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("o_"))


def paired_lists(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """Barcode conversion between two allow-lists (one file each) of which line n belongs to line n."""
    x = text_lines(spark, path_a).select("idx", F.col("value").alias("barcode"))
    y = text_lines(spark, path_b).select("idx", F.col("value").alias("converted"))
    return x.join(y, "idx").select("barcode", "converted")


# --- sparse matrices --------------------------------------------------------------------------------

def read_mex(spark: SparkSession, path: str, feature_type: str | None = None) -> DataFrame:
    """(barcode, feature, cnt) from a barcodes/features/matrix triple; orientation comes from the size line."""
    bc = text_lines(spark, f"{path}/barcodes", one_list=True).select("idx", F.col("value").alias("barcode"))
    f = F.split("value", "\t")
    ft = text_lines(spark, f"{path}/features", one_list=True).select("idx", f[0].alias("feature"), F.get(f, F.lit(2)).alias("feature_type"))
    lines = text_lines(spark, f"{path}/matrix")
    head = lines.filter(F.col("value").startswith("%")).agg(F.max_by("file", "idx").alias("file"), F.max("idx").alias("idx")).first()
    sizes = (F.col("file") == head.file) & (F.col("idx") == head.idx + 1)
    n_rows = int(lines.filter(sizes).first().value.split()[0])
    rows_are_features = n_rows == ft.count()
    p = F.split("value", " ")
    body = lines.filter(~F.col("value").startswith("%") & ~sizes).select(F.get(p, F.lit(0)).cast("bigint").alias("a"), F.get(p, F.lit(1)).cast("bigint").alias("b"), F.get(p, F.lit(2)).cast("bigint").alias("cnt"))
    r, c = ("feature_idx", "barcode_idx") if rows_are_features else ("barcode_idx", "feature_idx")
    body = body.withColumnsRenamed({"a": r, "b": c})
    if feature_type is not None:
        ft = ft.filter(F.col("feature_type") == feature_type)
    return (body.join(ft.withColumnRenamed("idx", "feature_idx"), "feature_idx").join(bc.withColumnRenamed("idx", "barcode_idx"), "barcode_idx")
            .select("barcode", "feature", "feature_type", "cnt"))


def split_libraries(mtx: DataFrame) -> DataFrame:
    """Library and plain barcode from decorated barcodes, prefix or suffix form."""
    pre, suf = F.regexp_extract("barcode", "^([^_-]+)_[ACGT]+", 1), F.regexp_extract("barcode", "^[ACGT]+(?:-1)?[-_]([^-_]+)$", 1)
    lib = F.when(pre != "", pre).when(suf != "", suf).otherwise("")
    return mtx.withColumn("library", lib).withColumn("barcode", F.regexp_extract("barcode", "[ACGT]+", 0))


# --- variants, alignments, reads ---------------------------------------------------------------------

def read_vcf(spark: SparkSession, path: str, min_qual: float = 50, allow_missing: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sites, genotypes) of unrepeated biallelic SNPs. A missing call is an absent row; samples are numbered as listed."""
    from poolcall.operators.sites import biallelic, unrepeated
    text = spark.read.text(path)
    names = text.filter(F.col("value").startswith("#CHROM")).first().value.split("\t")[9:]
    p = F.split("value", "\t")
    rec = text.filter(~F.col("value").startswith("#")).select(
        F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(1)).cast("bigint").alias("pos"), F.get(p, F.lit(3)).alias("ref"), F.get(p, F.lit(4)).alias("alt"), F.get(p, F.lit(5)).cast("float").alias("qual"),
        F.slice(p, 10, len(names)).alias("calls"))
    rec = unrepeated(rec).filter(biallelic(min_qual))  # every record at a repeated position goes, whatever its kind
    gt = F.transform("calls", lambda c: F.split(F.get(F.split(c, ":"), F.lit(0)), "[/|]"))
    nalt = F.transform(gt, lambda a: F.when(F.array_contains(a, "."), None).otherwise(F.size(F.filter(a, lambda x: x == "1"))))
    rec = rec.withColumn("nalt", nalt)
    if not allow_missing:
        rec = rec.filter(F.forall("nalt", lambda x: x.isNotNull()))
    geno = rec.select("chrom", "pos", F.posexplode("nalt").alias("sample", "nalt")).filter("nalt IS NOT NULL")
    return rec.select("chrom", "pos", "ref", "alt", "qual"), geno


def number_sites(sites: DataFrame) -> DataFrame:
    """A dense site_id in (chrom, pos) order, counted over range partitions."""
    from poolcall.scaling import running_totals
    return running_totals(sites, [F.col("chrom"), F.col("pos")], {"site_id": F.lit(1)})


def _tag(name: str) -> Column:
    v = F.regexp_extract("value", f"\t{name}:Z:([^\t]+)", 1)
    return F.when(v != "", v)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments with cell, UMI and gene tags; the end comes from the reference-consuming CIGAR parts."""
    p = F.split("value", "\t")
    d = spark.read.text(path).filter(~F.col("value").startswith("@")).select(
        F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).cast("int").alias("flag"), F.get(p, F.lit(2)).alias("chrom"), F.get(p, F.lit(3)).cast("bigint").alias("rstart"), F.get(p, F.lit(4)).cast("int").alias("mapq"),
        F.get(p, F.lit(5)).alias("cigar"), F.get(p, F.lit(9)).alias("seq"), F.get(p, F.lit(10)).alias("qual"), _tag("CB").alias("barcode"), _tag("UB").alias("umi"),
        F.split(_tag("GX"), ";").alias("gene_ids"))
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit("(\\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    return d.withColumn("rend", F.col("rstart") + span - 1)


def placed_blocks(alignments: DataFrame) -> DataFrame:
    """Adds ``blocks``: runs of read bases placed on the reference, each with reference start r, read offset q and length n."""
    from poolcall.functions.expr import pin
    ops = F.regexp_extract_all("cigar", F.lit("(\\d+[MIDNSHP=X])"), F.lit(1))
    state = F.struct(F.col("rstart").alias("r"), F.lit(0).cast("bigint").alias("q"),
                     F.array().cast("array<struct<r:bigint,q:bigint,n:bigint>>").alias("out"))

    def step(s, o):
        n, kind = F.expr("bigint(1)") * F.regexp_extract(o, "\\d+", 0).cast("bigint"), F.right(o, F.lit(1))
        both = kind.isin("M", "=", "X")
        return F.struct((s["r"] + F.when(both | kind.isin("D", "N"), n).otherwise(0)).alias("r"),
                        (s["q"] + F.when(both | kind.isin("I", "S"), n).otherwise(0)).alias("q"),
                        F.when(both, F.array_append(s["out"], F.struct(s["r"].alias("r"), s["q"].alias("q"), n.alias("n")))).otherwise(s["out"]).alias("out"))

    return pin(alignments, blocks=F.aggregate(ops, state, step)["out"])


def aligned_bases(alignments: DataFrame, key: str = "name") -> DataFrame:
    """(key, pos, base) for every read base placed on the reference."""
    from poolcall.functions.expr import pin
    d = pin(placed_blocks(alignments), bases=F.split("seq", ""))
    rows = F.flatten(F.transform("blocks", lambda b: F.transform(
        F.sequence(F.lit(0).cast("bigint"), b["n"] - 1), lambda i: F.struct((b["r"] + i).alias("pos"), F.get("bases", (b["q"] + i).cast("int")).alias("base")))))
    return d.select(key, F.explode(rows).alias("x")).select(key, "x.pos", "x.base")


BASE_BIN = 4096  # positions whose bases are counted together


def base_counts(alignments: DataFrame, bin_size: int = BASE_BIN) -> DataFrame:
    """(chrom, pos, base, n): reads that place a base on a position.

    Runs of placed bases are moved as texts to the bin they lie in, cut at its bounds, and fall apart only there. Bins in which a
    large share of the reads starts are counted before they are moved instead: they have many reads a position."""
    def start(c):
        return F.floor(F.col(c) / bin_size)

    hot = [(x.chrom, x.bin_) for x in hot_keys(alignments.select("chrom", start("rstart").alias("bin_")), ["chrom", "bin_"])]
    d = placed_blocks(alignments).select("chrom", "seq", F.explode("blocks").alias("b")).select("chrom", "seq", "b.*").filter("n > 0")
    d = d.withColumn("bin_", F.explode(F.sequence(start("r"), F.floor((F.col("r") + F.col("n") - 1) / bin_size))))
    lo = F.greatest(F.col("r"), F.col("bin_") * bin_size)
    size = (F.least(F.col("r") + F.col("n"), (F.col("bin_") + 1) * bin_size) - lo).cast("int")
    runs = d.select("chrom", "bin_", (lo - F.col("bin_") * bin_size).cast("int").alias("at"), size.alias("size"),
                    F.substring("seq", (F.col("q") + lo - F.col("r") + 1).cast("int"), size).alias("text"))

    def counted(runs):
        base = F.substring("text", F.col("i") + 1, F.lit(1))  # none where the text is shorter than its alignment
        one = runs.select("chrom", "bin_", "at", "text", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("i"))
        one = one.select("chrom", "bin_", (F.col("at") + F.col("i")).alias("at"), F.when(base != "", base).alias("base"))
        return one.groupBy("chrom", "bin_", "at", "base").agg(F.count(F.lit(1)).alias("n"))

    if hot:
        is_hot = reduce(lambda a, b: a | b, [F.col("chrom").eqNullSafe(F.lit(c)) & F.col("bin_").eqNullSafe(F.lit(k)) for c, k in hot])
        out = counted(runs.filter(is_hot)).unionByName(counted(runs.filter(~is_hot).repartition("chrom", "bin_")))
    else:
        out = counted(runs.repartition("chrom", "bin_"))
    return out.select("chrom", (F.col("bin_") * bin_size + F.col("at")).alias("pos"), "base", "n")


HEAD = "^@(\\S+?)(?:/[123])?(?:\\s|$)"  # read name in the first line of a record


def read_fastq(spark: SparkSession, path: str, mate: str) -> DataFrame:
    """Four-line records of every file under ``path``: (chunk, record, mate, read_id, seq, qual); ``chunk`` is the file's path under ``path``."""
    d = text_lines(spark, path).withColumn("record", F.floor((F.col("idx") - 1) / 4)).withColumn("k", (F.col("idx") - 1) % 4)
    name = F.regexp_extract("head", HEAD, 1)
    g = d.groupBy("file", "record").agg(*[F.max(F.when(F.col("k") == k, F.col("value"))).alias(c) for k, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    return g.select(F.substring_index("file", f"{path.rstrip('/')}/", -1).alias("chunk"), "record", F.lit(mate).alias("mate"), name.alias("read_id"), "seq", "qual")


def _numbered_pairs(spark: SparkSession, chunks: DataFrame, k: int, files: list[tuple[str, ...]] | None) -> DataFrame:
    """``chunks(chunk, ...)`` of mate ``k`` with ``pair``, the number of the chunk; one that is not listed is an error."""
    if files is None:
        pairs = chunks.select("chunk").distinct().withColumn("pair", F.row_number().over(W.orderBy("chunk")))  # one row per file
    else:
        pairs = spark.createDataFrame([(f[k - 1], n) for n, f in enumerate(files, 1)], "chunk string, pair int")
    d = chunks.join(F.broadcast(pairs), "chunk", "left")  # one row per file, which the driver has listed
    return d.withColumn("pair", F.coalesce("pair", F.raise_error(F.concat(F.lit("no mates are listed for "), "chunk")).cast("int")))


def _same_names(joined: DataFrame, n: int) -> DataFrame:
    same = F.lit(True)
    for k in range(2, n + 1):
        same = same & F.col("read_id1").eqNullSafe(F.col(f"read_id{k}"))
    where = F.concat(F.lit("mates out of order at record "), "record", F.lit(" of chunk "), "pair")
    rid = F.when(same, F.col("read_id1")).otherwise(F.raise_error(where))
    return joined.select(rid.alias("read_id"), *[f"{c}{k}" for k in range(1, n + 1) for c in ("seq", "qual")])


def pair_mates(*mates: DataFrame, files: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Record n of a chunk with record n of its mates' chunks: (read_id, seq1, qual1, seq2, qual2, ...), two mates or more.

    Chunks go together as ``files`` lists their names (one tuple a chunk, in the order of the mates), else in the order of their names.
    Different read names, a missing record, a chunk without its mates and a chunk that is not listed are errors."""
    joined = None
    for k, m in enumerate(mates, 1):
        d = _numbered_pairs(m.sparkSession, m, k, files).select("pair", "record", *[F.col(c).alias(f"{c}{k}") for c in ("read_id", "seq", "qual")])
        joined = d if joined is None else joined.join(d, ["pair", "record"], "full")
    return _same_names(joined, len(mates))


def read_mates(spark: SparkSession, *paths: str, files: list[tuple[str, ...]] | None = None) -> DataFrame:
    """:func:`pair_mates` of the files under each of ``paths``, in one grouping of all mates' lines by (pair, record): the lines
    of a record are put together where they are read, and each record is moved once."""
    lines = []
    for k, path in enumerate(paths, 1):
        at = split_starts(spark, path).withColumn("chunk", F.substring_index("file", f"{path.rstrip('/')}/", -1))
        at = _numbered_pairs(spark, at, k, files).select("file", "b_", "f_", "o_", "pair")
        row = F.col("m_") - F.col("f_") + F.col("o_")
        lines.append(split_lines(spark, path).join(F.broadcast(at), ["file", "b_"]).filter(row % 4 != 2).select(
            "pair", F.floor(row / 4).alias("record"), (k * 4 + row % 4).cast("int").alias("k_"), "value"))
    name = F.regexp_extract("value", HEAD, 1)
    d = reduce(DataFrame.unionByName, lines).select("pair", "record", "k_", F.when(F.col("k_") % 4 == 0, name).otherwise(F.col("value")).alias("value"))
    parts = [F.max(F.when(F.col("k_") == 4 * k + line, F.col("value"))).alias(f"{c}{k}") for k in range(1, len(paths) + 1) for line, c in ((0, "read_id"), (1, "seq"), (3, "qual"))]
    return _same_names(d.groupBy("pair", "record").agg(*parts), len(paths))


# --- small text tables --------------------------------------------------------------------------------

ASSIGNMENTS = "barcode STRING, id STRING, type STRING, llr DOUBLE"


def read_assignments(spark: SparkSession, path: str, min_llr: float = 0.0, keep_doublets: bool = True) -> DataFrame:
    d = spark.read.schema(ASSIGNMENTS).csv(path, sep="\t").filter(F.col("llr") > min_llr)
    d = d.withColumn("barcode", F.regexp_replace("barcode", "-1$", ""))
    return d if keep_doublets else d.filter("type = 'S'")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Half-open intervals of genes and exons."""
    p = F.split("value", "\t")
    return spark.read.text(path).filter(~F.col("value").startswith("#")).select(
        F.get(p, F.lit(0)).alias("chrom"), F.get(p, F.lit(2)).alias("feature"), (F.get(p, F.lit(3)).cast("bigint") - 1).alias("start"), F.get(p, F.lit(4)).cast("bigint").alias("end")).filter(
        F.col("feature").isin("gene", "exon"))


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.schema("chrom STRING, start BIGINT, end BIGINT, score DOUBLE").csv(path, sep="\t")
    return d.filter("start IS NOT NULL AND NOT chrom LIKE 'track%' AND NOT chrom LIKE '#%'")


def read_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """Two-column name map; a key given twice with different values is an error."""
    d = spark.read.schema(f"{key} STRING, {value} STRING").csv(path, sep="\t").distinct()
    n = d.groupBy(key).agg(F.count(F.lit(1)).alias("n_"), F.min(value).alias(value))
    return n.select(key, F.when(F.col("n_") > 1, F.raise_error(F.concat(F.lit("two values for "), F.col(key)))).otherwise(F.col(value)).alias(value))


def read_haps(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, site, allele) from one 0/1/- text per line; a dash is an absent row."""
    d = text_lines(spark, path).select((F.col("idx") - 1).alias("cluster"), F.posexplode(F.split("value", "")).alias("site", "c"))
    return d.filter(F.col("c").isin("0", "1")).select("cluster", "site", F.col("c").cast("int").alias("allele"))


def read_props(spark: SparkSession, path: str) -> DataFrame:
    """(member, share) from a two- or three-column composition file or, with four columns, from an assignment file."""
    from poolcall.operators.labels import composition
    width = len(spark.read.text(path).first().value.split("\t"))
    if width >= 4:
        return composition(read_assignments(spark, path)).select("member", "share")
    return spark.read.schema("member STRING, share DOUBLE, conc DOUBLE").csv(path, sep="\t").select("member", "share")
