"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import discarded, new_path, settled, shared_dir

__all__ = ["SPACE", "WORD", "discarded", "give_back", "joined", "new_path", "shared_dir", "table", "text_slices", "written"]

#: White space of the contracts: space and the five ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    return settled(df, label)


#: A key with so many rows is heavy; at most so many of the heaviest keys are broadcast (below 100 bytes each) and salted.
HEAVY, MOST_HEAVY, MOST_SALTS = 10_000, 20_000, 1_024


def joined(rows: DataFrame, keys: DataFrame, on: list[str], weights: DataFrame, weight: str, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with a table of keys, where ``weights`` says how many rows a key has.

    The rows of the heaviest keys, a bounded number of keys, are salted by a hash of the row, and these keys' own rows
    repeated for every salt, so that about ``HEAVY`` rows of a key meet in a task. The result is the plain join's.
    """
    if weights.where(F.col(weight) >= HEAVY).isEmpty():
        return rows.join(keys, on, how)
    salts = F.least(F.ceil(F.max(weight) / HEAVY), F.lit(MOST_SALTS)).cast("int")
    heavy = weights.where(F.col(weight) >= HEAVY).groupBy(*on).agg(salts.alias("_salts")).orderBy(F.col("_salts").desc(), *on).limit(MOST_HEAVY)
    heavy = written(heavy, "heavy")
    place = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_salts"))).cast("int")
    salted = rows.join(F.broadcast(heavy), on, "left").withColumn("_salt", place).drop("_salts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    repeated = keys.join(F.broadcast(heavy), on, "left").withColumn("_salt", every).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None


def give_back() -> None:
    """Return what a task has freed to the machine: workers live on between tasks, and idle ones would keep it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20, rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of an Arrow batch of about ``most`` bytes of UTF-8 text and ``rows`` rows, or one longer row.

    Yields (first row, one past the last, offsets, bytes); offsets start at 0 and nulls are empty.
    The arrays are views of the batch: no text is decoded or copied.
    """
    col = batch.column(batch.schema.get_field_index(column))
    n = len(col)
    if not n:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1), start + rows, n)
        yield start, end, offsets[start : end + 1] - offsets[start], data[offsets[start] : offsets[end]]
        start = end


