"""Fixture views: the engine's logical tables derived from the given tables, in whole.

Each view has one SQL text; most run unchanged in both engines. Where a join is better written with one
of our operators the Spark side overrides it. Pool members are the five regions; cells are suppliers;
variant sites are parts; aligned reads are line items."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


SPARK_FORMS: dict[str, str] = {}  # SQL of both engines -> the same value in one step of Spark


def acgt(key: str, n: int) -> str:
    """SQL for an n-base text of a whole key of at least 0 (base-4 digits, least significant last).

    Spark gets it as one change of base: n digits one by one make a method too long to be compiled."""
    digits = [f"substr('ACGT', CAST(floor(({key}) / {4 ** i}) AS BIGINT) % 4 + 1, 1)" for i in range(n - 1, -1, -1)]
    text = "concat(" + ", ".join(f"CAST({d} AS STRING)" for d in digits) + ")"
    own = f"lpad(conv(CAST(({key}) % {4 ** n} AS STRING), 10, 4), {n}, '0')"
    for digit, base in enumerate("ACGT"):
        own = f"replace({own}, '{digit}', '{base}')"
    SPARK_FORMS[text] = own
    return text


# allele dose of member m at site s: 0, 1, 2; a missing call when MISSING holds
DOSE = "CAST((({s} * 7919 + {m} * 104729 + {s} * {m} * 31) % 97) % 3 AS INT)"
MISSING = "(({s} * 13 + {m} * 29) % 53 = 0)"


def dose0(s: str, m: str) -> str:
    return f"CASE WHEN {MISSING.format(s=s, m=m)} THEN 0 ELSE {DOSE.format(s=s, m=m)} END"


VIEWS: dict[str, str] = {
    "fx_samples": "SELECT r_regionkey AS sample, r_name AS name FROM region",
    "fx_sites": """
        SELECT p_partkey AS site_id, concat('chr', CAST(p_partkey % 4 AS STRING)) AS chrom,
               CAST(floor(p_partkey / 4) AS BIGINT) * 40 + 1 AS pos, p_size AS qual,
               substr('ACGT', CAST(p_partkey % 4 AS INT) + 1, 1) AS ref,
               substr('ACGT', CAST((p_partkey + 1 + p_partkey % 3) % 4 AS INT) + 1, 1) AS alt
        FROM part""",
    "fx_genotypes": f"""
        SELECT s.site_id, CAST(m.sample AS INT) AS sample, {DOSE.format(s='s.site_id', m='m.sample')} AS nalt
        FROM fx_sites s CROSS JOIN fx_samples m
        WHERE NOT {MISSING.format(s='s.site_id', m='m.sample')}""",
    "fx_truth": """
        SELECT s_suppkey AS barcode,
               CAST(CASE s_suppkey % 8 WHEN 5 THEN 0 WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE s_suppkey % 8 END AS INT) AS i,
               CAST(CASE s_suppkey % 8 WHEN 5 THEN 1 WHEN 6 THEN 3 WHEN 7 THEN 4 ELSE s_suppkey % 8 END AS INT) AS j
        FROM supplier""",
    "fx_reads": """
        SELECT l_orderkey * 8 + l_linenumber AS read_id, l_suppkey AS barcode,
               concat('chr', CAST(l_partkey % 4 AS STRING)) AS chrom,
               CAST(floor(l_partkey / 4) AS BIGINT) * 40 + 1 - l_linenumber * 5 AS rstart,
               CAST(floor(l_partkey / 4) AS BIGINT) * 40 + 1 - l_linenumber * 5 + 59 AS rend,
               CAST(l_quantity AS INT) + 10 AS mapq,
               CASE l_returnflag WHEN 'R' THEN 1024 WHEN 'A' THEN 16 ELSE 0 END AS flag,
               CAST(l_partkey % 50 AS INT) AS gene, l_orderkey, l_linenumber
        FROM lineitem""",
    "fx_pileup": f"""
        SELECT r.read_id, r.barcode, s.site_id, r.mapq, r.gene,
               CASE WHEN (r.l_orderkey * 61 + r.l_linenumber * 17 + s.site_id * 7) % 1000
                         < 10 + 245 * (({dose0('s.site_id', 't.i')}) + ({dose0('s.site_id', 't.j')}))
                    THEN 1 ELSE 0 END AS is_alt
        FROM fx_reads r
        JOIN fx_sites s ON r.chrom = s.chrom AND s.pos >= r.rstart AND s.pos <= r.rend
        JOIN fx_truth t ON t.barcode = r.barcode""",
    "fx_cell_site": """
        SELECT barcode, site_id,
               CAST(sum(CASE WHEN is_alt = 0 THEN CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT) ELSE 0 END) AS BIGINT) AS ref_w,
               CAST(sum(CASE WHEN is_alt = 1 THEN CAST(round((1 - pow(10.0, -mapq / 10.0)) * 1000000) AS BIGINT) ELSE 0 END) AS BIGINT) AS alt_w
        FROM fx_pileup GROUP BY barcode, site_id""",
    "fx_tag_reads": """
        SELECT event_id AS read_id, user_id AS barcode, CAST(event_id % 64 AS INT) AS umi, event_type AS tag, ts
        FROM events""",
    "fx_tag_counts": "SELECT barcode, tag, count(DISTINCT umi) AS cnt FROM fx_tag_reads GROUP BY barcode, tag",
    "fx_mtx": """
        SELECT l_suppkey AS barcode, l_partkey AS gene, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cnt
        FROM lineitem GROUP BY l_suppkey, l_partkey""",
    # two callers disagree in part; a cell is only labelled by a caller whose LLR is positive
    "fx_labels_a": """
        SELECT barcode, id, type, llr FROM (
          SELECT o_orderkey AS barcode,
                 CASE WHEN o_orderkey % 10 < 8 THEN concat('S', CAST(o_custkey % 5 AS STRING))
                      ELSE concat('S', CAST(o_custkey % 4 AS STRING), '+S', CAST(o_custkey % 4 + 1 AS STRING)) END AS id,
                 CASE WHEN o_orderkey % 10 < 8 THEN 'S' ELSE 'D' END AS type,
                 CAST(round(o_totalprice) AS BIGINT) / 1000 - 20 AS llr
          FROM orders) a0
        WHERE llr > 0""",
    "fx_labels_b": """
        SELECT barcode, id, type, llr FROM (
          SELECT o_orderkey AS barcode,
                 CASE WHEN o_orderkey % 9 < 7
                      THEN concat('S', CAST((o_custkey + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END) % 5 AS STRING))
                      ELSE concat('S', CAST(o_custkey % 4 AS STRING), '+S', CAST(o_custkey % 4 + 1 AS STRING)) END AS id,
                 CASE WHEN o_orderkey % 9 < 7 THEN 'S' ELSE 'D' END AS type,
                 CASE WHEN o_orderkey % 7 = 0 THEN CAST(round(o_totalprice) AS BIGINT) / 1000
                      ELSE (o_custkey % 400) - 30.5 END AS llr
          FROM orders) b0
        WHERE llr > 0""",
}

DEPENDS: dict[str, list[str]] = {
    name: [v for v in re.findall(r"\bfx_\w+", text) if v != name] for name, text in VIEWS.items()
}


BUILDERS: dict = {}  # Spark forms of added views: fn(fixtures) -> DataFrame


def add_view(name: str, text: str, spark=None) -> None:
    """Add a view used by one family of queries; ``spark`` builds it with operators instead of the SQL."""
    VIEWS[name] = text
    if spark is not None:
        BUILDERS[name] = spark
    DEPENDS[name] = [v for v in re.findall(r"\bfx_\w+", text) if v != name]


def _closure(text: str) -> list[str]:
    order: list[str] = []

    def visit(v: str) -> None:
        if v in order:
            return
        for d in DEPENDS[v]:
            visit(d)
        if v not in order:
            order.append(v)

    for v in re.findall(r"\bfx_\w+", text):
        visit(v)
    return order


def oracle(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it names."""
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in _closure(sql))
    body = sql.strip()
    recursive = False
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, rest = True, body[len("WITH RECURSIVE"):]
    elif body.upper().startswith("WITH"):
        rest = body[len("WITH"):]
    else:
        rest = None
    if not ctes:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return f"{head}{ctes}{',' if rest else ''}\n{rest if rest else body}"


class Fixtures:
    """Tables and views of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._seen: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in BASE_TABLES:
            return self.table(name)
        return self.view(name if name.startswith("fx_") else f"fx_{name}")

    def table(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._seen[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._seen:
            own = getattr(type(self), f"_{name}", None) or BUILDERS.get(name)
            self._seen[name] = own(self) if own else self.sql(VIEWS[name])
        return self._seen[name]

    def spread_sql(self, text: str, table: str, *keys: str) -> DataFrame:
        """As :meth:`sql`, with a scan of few splits spread over the cores first (the steps after it multiply rows)."""
        from poolcall.scaling import spread
        return self.sql(text, {table: spread(self.table(table), *keys)})

    def sql(self, text: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
        """Run SQL over base tables and fixture views."""
        names = sorted({w for w in re.findall(r"\b[a-z_]+\b", text) if w in BASE_TABLES or w in VIEWS})
        for both, own in SPARK_FORMS.items():
            text = text.replace(both, own)
        marked = text.replace("{", "{{").replace("}", "}}")
        for n in names:
            marked = re.sub(rf"(?i)\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", marked)
        used = [n for n in names if f"{{{n}}}" in marked]
        given = given or {}
        return self.spark.sql(marked, **{n: given[n] if n in given else (self.table(n) if n in BASE_TABLES else self.view(n)) for n in used})

    # Spark forms that use an operator or avoid a join

    def _fx_reads(self) -> DataFrame:
        return self.spread_sql(VIEWS["fx_reads"], "lineitem", "l_orderkey", "l_linenumber")

    def _fx_genotypes(self) -> DataFrame:
        from poolcall.session import collect_bounded
        members = sorted(x.sample for x in collect_bounded(self.fx_samples.select("sample"), 2048))
        s = self.fx_sites.select("site_id", F.explode(F.array(*[F.lit(m) for m in members])).alias("sample"))
        return s.filter("NOT " + MISSING.format(s="site_id", m="sample")).select(
            "site_id", F.col("sample").cast("int"), F.expr(DOSE.format(s="site_id", m="sample")).alias("nalt"))

    def _fx_pileup(self) -> DataFrame:
        from poolcall.operators.joins import range_join
        r = self.fx_reads.join(self.fx_truth, "barcode")
        p = range_join(r, self.fx_sites.select("site_id", "chrom", "pos"), salt_by=["read_id"])
        dose = F.expr(f"({dose0('site_id', 'i')}) + ({dose0('site_id', 'j')})")
        hit = (F.col("l_orderkey") * 61 + F.col("l_linenumber") * 17 + F.col("site_id") * 7) % 1000 < 10 + 245 * dose
        return p.select("read_id", "barcode", "site_id", "mapq", "gene", hit.cast("int").alias("is_alt"))

    def _fx_cell_site(self) -> DataFrame:
        from poolcall.operators.counts import cell_site_counts
        return cell_site_counts(self.fx_pileup)
