"""The mutation log: versions, states at a time, differences, upserts.

log: entity_id, ts, seq (order within a moment), state (null: removed), and further columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def in_range(log: DataFrame, since: str | None = None, until: str | None = None, **equal: str) -> DataFrame:
    """Events between two times, both included, with all given values."""
    out = log
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until).cast("timestamp_ntz"))
    for name, value in equal.items():
        out = out.where(F.col(name) == value)
    return out


def versions(log: DataFrame) -> DataFrame:
    """entity_id, revision, tx_from, tx_to (null: current), state: one row per change; repeats of a state are none."""
    w = Window.partitionBy("entity_id").orderBy("ts", "seq")
    before = log.withColumn("_before", F.lag("state").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    changed = before.where(F.col("_first") | ~F.col("state").eqNullSafe(F.col("_before")))
    return changed.select("entity_id", F.row_number().over(w).alias("revision"), F.col("ts").alias("tx_from"), F.lead("ts").over(w).alias("tx_to"), "state")


def state_at(log: DataFrame, moment: str) -> DataFrame:
    """entity_id, state as of a time; removed ones are left out. An aggregate with map-side combine, no sort."""
    past = log.where(F.col("ts") <= F.lit(moment).cast("timestamp_ntz"))
    last = past.groupBy("entity_id").agg(F.max(F.struct("ts", "seq", "state")).alias("_last"))
    return last.select("entity_id", F.col("_last.state").alias("state")).where("state is not null")


def difference(log: DataFrame, earlier: str, later: str) -> DataFrame:
    """entity_id, change (added, removed, changed) between two times; what did not change is left out."""
    a = state_at(log, earlier).withColumnRenamed("state", "_a")
    b = state_at(log, later).withColumnRenamed("state", "_b")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "entity_id", "full").select("entity_id", change.alias("change")).where("change is not null")


def upsert(current: DataFrame, incoming: DataFrame, expected: bool = False) -> DataFrame:
    """id, action (create, update, none, conflict, keep), revision, state after merging incoming (id, state) into current (id, revision, state).

    With ``expected``, incoming rows name the revision they were made for, and others are conflicts.
    """
    new = incoming.select("id", F.col("state").alias("_new"), *([F.col("expected_revision")] if expected else []), F.lit(True).alias("_in"))
    both = current.join(new, "id", "full")
    clash = F.col("expected_revision").isNotNull() & ~F.col("expected_revision").eqNullSafe(F.col("revision")) if expected else F.lit(False)
    action = F.when(F.col("_in").isNull(), "keep").when(clash, "conflict").when(F.col("revision").isNull(), "create").when(F.col("state").eqNullSafe(F.col("_new")), "none").otherwise("update")
    both = both.withColumn("action", action)
    takes = F.col("action").isin("create", "update")
    return both.select("id", "action", F.when(takes, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"), F.when(takes, F.col("_new")).otherwise(F.col("state")).alias("state"))


def retired(current: DataFrame, ids: DataFrame, moment: str) -> DataFrame:
    """current with the given ids retired: status, valid_to and a revision more."""
    hit = current.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    on = F.coalesce("_hit", F.lit(False)) & (F.col("lifecycle_status") != "retired")
    return hit.withColumns({"revision": F.when(on, F.col("revision") + 1).otherwise(F.col("revision")), "valid_to": F.when(on, F.lit(moment)).otherwise(F.col("valid_to")), "lifecycle_status": F.when(on, "retired").otherwise(F.col("lifecycle_status"))}).drop("_hit")


def removed(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, events) after removing ids with their edges; events: kind, entity_id, step, edges first."""
    gone = ids.select("id").distinct()
    ends = edges.join(gone.withColumnRenamed("id", "source_id").withColumn("_s", F.lit(True)), "source_id", "left").join(gone.withColumnRenamed("id", "target_id").withColumn("_t", F.lit(True)), "target_id", "left")
    cut = F.coalesce("_s", F.lit(False)) | F.coalesce("_t", F.lit(False))
    events = ends.where(cut).select(F.lit("EdgeRemoved").alias("kind"), F.col("id").alias("entity_id"), F.lit(1).alias("step"))
    events = events.unionByName(nodes.join(gone, "id", "left_semi").select(F.lit("NodeRetired").alias("kind"), F.col("id").alias("entity_id"), F.lit(2).alias("step")))
    return nodes.join(gone, "id", "left_anti"), ends.where(~cut).select(*edges.columns), events


def clocked(rows: DataFrame, start: str) -> DataFrame:
    """rows with strictly rising moments in the order of ``ord``, a millisecond apart, for each entity's batch."""
    n = F.row_number().over(Window.partitionBy("entity_id").orderBy("ord")) - 1
    return rows.withColumn("ts", F.timestamp_millis(F.unix_millis(F.lit(start).cast("timestamp")) + n))
