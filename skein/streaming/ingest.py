"""Streams: JSONL entries through the gates into tables, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import ENTRY


def stream_entries(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_batch).json(path)


def fan_out(batch: DataFrame, sinks: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Every sink gets the batch, whatever happens to the others: name -> completed or the error; all of them: 'state'."""
    batch.persist()
    out = {}
    try:
        for name, sink in sinks.items():
            try:
                sink(batch)
                out[name] = "completed"
            except Exception as e:  # noqa: BLE001 a sink's failure is its result
                out[name] = f"failed: {e}"
    finally:
        batch.unpersist()
    done = sum(v == "completed" for v in out.values())
    return out | {"state": "completed" if done == len(sinks) else "partial" if done else "failed"}


def load_stream(stream: DataFrame, gate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Batches through a gate into a folder per status; a batch that is repeated overwrites its own folder."""

    def load(batch: DataFrame, number: int) -> None:
        gate(batch).write.mode("overwrite").partitionBy("status").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_entry(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each (run_id, entry_id) once within the watermark; stream has ts."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run_id", "entry_id"])


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of events in tumbling or sliding windows; the same for tables and streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed.groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of bursts of events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def invalidated(events: DataFrame, kinds: list[str]) -> DataFrame:
    """Events that make a view over some types stale."""
    return events.where(F.col("entity_type").isin(*kinds))
