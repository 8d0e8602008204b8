"""Incremental counting as reads arrive."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["barcode", "tag", "umi"]
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, outside the heap."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def dedupe_stream(reads: DataFrame, path: str, checkpoint: str, time: str | None = None, horizon: str | None = None) -> StreamingQuery:
    """Write each new (barcode, tag, umi) once. Exactly once across restarts: the file sink commits with the state.

    Without ``horizon`` every UMI ever seen is kept as state. With it (an interval, by the timestamp column ``time``) a
    UMI is forgotten once the newest time is further ahead than that: state holds the UMIs of one horizon, in RocksDB. A
    copy within the horizon is always dropped; a copy later than that counts anew if it is not late itself; rows later
    than the horizon are left out and counted by :func:`late_rows`."""
    if horizon is None:
        new = reads.select(*KEYS).dropDuplicates(KEYS)
    else:
        new = reads.select(*KEYS, time).withWatermark(time, horizon).dropDuplicatesWithinWatermark(KEYS).select(*KEYS)
    with state_on_disk(reads.sparkSession):
        return (new.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """Rows that came too late for the state, over the progress reports that the query keeps."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query: StreamingQuery) -> int:
    """Rows of state after the last batch."""
    return sum(op["numRowsTotal"] for op in query.lastProgress["stateOperators"])


def count_stream(rows: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Running counts per key. Each micro-batch writes the keys it changed under its own batch folder, so a
    batch that is run again replaces itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with state_on_disk(rows.sparkSession):
        return (rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).writeStream.outputMode("update")
                .option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start())


def latest_counts(saved: DataFrame, keys: list[str]) -> DataFrame:
    """Current value of each key: counts only grow, so it is the largest."""
    return saved.groupBy(*keys).agg(F.max("cnt").alias("cnt"))


def partial_counts(rows: DataFrame, keys: list[str], path: str, checkpoint: str):
    """Chunk-wise partial counts: each micro-batch is counted on its own, without state; merge them by sum."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
