"""Shared by the operators: reading tables, words, window hashes and batch-wise maps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, for the two independent window hashes
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column | str) -> Column:
    """Number of words of a text column; null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def words_of(text: str | None) -> list[bytes]:
    """The words as UTF-8. ``bytes.split`` cuts at exactly the six separators 09-0D and 20, which no multi-byte character holds."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(x: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries, joined from runs of doubling length."""
    n = len(x) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    m = MULTIPLIERS[which]
    run, length, out, done = x, 1, None, 0
    while length <= size:
        if size & length:
            part = run[done:done + n]
            out = part.copy() if out is None else out * np.uint64(pow(m, length, 1 << 64)) + part
            done += length
        if 2 * length <= size:
            run = run[:-length] * np.uint64(pow(m, length, 1 << 64)) + run[length:]
        length *= 2
    return mixed(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def record_batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


SLICE = 1_000  # rows of a batch that are Python objects at one time


def slices(batches, rows: int = SLICE):
    """The batches in short slices, so a worker's memory stays that of a slice; freed buffers go back to the system."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
        pa.default_memory_pool().release_unused()


def map_batches(df: DataFrame, fn: Callable, ddl: str) -> DataFrame:
    """``fn`` gets the columns of one Arrow batch as lists and returns the output columns."""
    schema = arrow_schema(ddl)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield record_batch(fn(*[c.to_pylist() for c in b.columns]), schema)

    return df.mapInArrow(run, ddl)


def map_texts(df: DataFrame, fn: Callable, ddl: str, *keep: str, text: str = "text", with_key: bool = False) -> DataFrame:
    """One row per row of ``df``: the columns ``keep`` unchanged, then the values that ``fn(text)`` returns, or
    ``fn(key, text)`` with the first kept column."""
    kinds = dict((f.name, f.dataType.simpleString()) for f in df.schema)
    full = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), ddl])
    schema = arrow_schema(full)

    def run(batches):
        for b in slices(batches):
            if b.num_rows:
                texts = b.column(len(keep)).to_pylist()
                made = list(zip(*([fn(k, t) for k, t in zip(b.column(0).to_pylist(), texts)] if with_key else [fn(t) for t in texts])))
                kept = [b.column(i) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(kept, schema)), *(pa.array(c, f.type) for c, f in zip(made, list(schema)[len(keep):]))], schema=schema)

    return df.select(*keep, text).mapInArrow(run, full)
