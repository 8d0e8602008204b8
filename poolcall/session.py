"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "poolcall", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults above; ``master`` is only given for local runs."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = getattr(sc, "_poolcall_scratch", None)
    if own is None:
        own = sc._poolcall_scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written inside one :func:`scratch_scope`."""

    def __init__(self):
        self.written: set[str] = set()
        self.kept: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, as :func:`cut` returned it, outlives the scope."""
        self.kept.add(df.scratch_path_)
        return df


_scopes: list[Scratch] = []


@contextmanager
def scratch_scope(spark: SparkSession):
    """Remove every table that :func:`cut` writes inside, but for those given to ``keep``, when the block ends.

    For operators that settle their result in a written table and return a plan over that table alone."""
    scope = Scratch()
    _scopes.append(scope)
    try:
        yield scope
    finally:
        _scopes.remove(scope)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in scope.written - scope.kept:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Ends the lineage (a lost executor never replays the plan behind it), gives later jobs exact
    file sizes to plan with, and keeps column pruning on the reread."""
    path = fresh_path(df.sparkSession, "cut")
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _scopes:
        out.scratch_path_ = path
        _scopes[-1].written.add(path)
    return out


PASS_LIMIT = 10_000  # a fit that has not settled by then is an error


def not_settled(what: str, passes: int, moved: float) -> RuntimeError:
    return RuntimeError(f"{what} did not settle in {passes} passes: the last change was {moved}")


def collect_bounded(df: DataFrame, limit: int) -> list:
    """Collect a parameter table whose size is bounded by the model, checking that bound."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"parameter table holds more than {limit} rows")
    return rows


def local_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A parameter table from driver values, planned as a local relation of known size (so joins broadcast it)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    cols = list(zip(*[tuple(x) for x in rows])) if rows else [[] for _ in schema]
    return spark.createDataFrame(pa.table([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema))
