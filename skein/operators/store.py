"""The write side of the graph: batches of staged operations that take effect as a whole or not at all.

nodes: id, revision, state; edges: id, type, source_id, target_id, ord (arrival). Operations: seq (their order),
kind (upsert, create_edge, remove_edge), id, state, expected_revision, type, source_id, target_id. Nothing is
written in place: a batch that holds gives the next tables, one that does not gives the old ones and its errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import settled
from .gates import Rules


def _upserts(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """Each upsert with the state and revision before it and what it does: create, update, none or conflict."""
    mine = ops.where("kind = 'upsert'").select("seq", "id", "state", "expected_revision")
    start = nodes.join(mine.select("id").distinct(), "id", "left_semi").select(F.lit(-1).cast("long").alias("seq"), "id", "state", F.col("revision").alias("_start"))
    both = start.unionByName(mine.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    w = Window.partitionBy("id").orderBy("seq")
    lined = both.withColumns({"_first": F.row_number().over(w) == 1, "_before": F.lag("state").over(w)})
    # a row changes the state if it is the first of its id or differs from the row before it
    changes = F.col("_start").isNull() & (F.col("_first") | ~F.col("state").eqNullSafe(F.col("_before")))
    counted = lined.withColumn("_changes", changes.cast("int")).withColumn("revision", F.coalesce(F.first("_start", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)) + F.sum("_changes").over(w))
    old = F.col("revision") - F.col("_changes")
    action = F.when((old > 0) & F.col("expected_revision").isNotNull() & (F.col("expected_revision") != old), "conflict").when(F.col("_changes") == 0, "none").when(old == 0, "create").otherwise("update")
    return counted.where("_start is null").select("seq", "id", "state", F.col("_before").alias("before"), "revision", action.alias("action"))


def _edge_steps(edges: DataFrame, ops: DataFrame, rules: Rules) -> DataFrame:
    """Each edge operation with its error, if any: beyond the targets that its type allows, or nothing to remove."""
    mine = ops.where("kind in ('create_edge', 'remove_edge')").select(F.col("seq").cast("long").alias("seq"), "kind", "id", "type", "source_id", "target_id")
    delta = mine.withColumn("_d", F.when(F.col("kind") == "create_edge", 1).otherwise(-1))
    for keys, name in ((["source_id", "type"], "_of_source"), (["source_id", "target_id", "type"], "_of_ends")):
        counts = edges.join(mine.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{name}_held"))
        before = F.sum("_d").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
        delta = delta.join(counts, keys, "left").withColumn(name, F.coalesce(f"{name}_held", F.lit(0)) + F.coalesce(before, F.lit(0)))
    most = rules.column(F.col("type"), 3)
    error = F.when((F.col("kind") == "create_edge") & (F.col("_of_source") >= most), "cardinality").when((F.col("kind") == "remove_edge") & (F.col("_of_ends") <= 0), "not found")
    return delta.select("seq", "kind", "id", "type", "source_id", "target_id", error.alias("error"))


def commit(nodes: DataFrame, edges: DataFrame, ops: DataFrame, rules: Rules = Rules()) -> dict:
    """nodes, edges, events (seq, kind, entity_id, before, after) and errors (seq, id, error) of a batch; nodes keep their further columns.

    All operations are judged in their order, each after those before it; with any error nothing changes and there
    are no events. Ends of edges are not checked here, as loading checks them. A removal takes the edge that arrived
    first. Only the ids and ends that a batch names are read from the tables for judging.
    """
    ups, steps = settled(_upserts(nodes, ops)), settled(_edge_steps(edges, ops, rules))
    errors = ups.where("action = 'conflict'").select("seq", "id", F.lit("conflict").alias("error")).unionByName(steps.where("error is not null").select("seq", "id", "error"))
    if not errors.isEmpty():
        none = ups.limit(0).select("seq", F.lit("").alias("kind"), F.col("id").alias("entity_id"), F.col("before"), F.col("state").alias("after"))
        return {"nodes": nodes, "edges": edges, "events": none, "errors": errors}
    last = ups.where("action <> 'none'").groupBy("id").agg(F.max(F.struct("seq", "revision", "state")).alias("_l")).select("id", "_l.revision", "_l.state")
    now = last.select("id", F.col("revision").cast(nodes.schema["revision"].dataType).alias("_revision"), F.col("state").alias("_state"))
    changed = F.col("_revision").isNotNull()
    stay = nodes.join(now, "id", "left").withColumns({"revision": F.coalesce("_revision", "revision"), "state": F.when(changed, F.col("_state")).otherwise(F.col("state"))}).select(*nodes.columns)
    first = now.join(nodes.select("id"), "id", "left_anti").select("id", F.col("_revision").alias("revision"), F.col("_state").alias("state"))
    new_nodes = stay.unionByName(first, allowMissingColumns=True)
    made = steps.where("kind = 'create_edge'").select("id", "type", "source_id", "target_id", "seq")
    ends = ["source_id", "target_id", "type"]
    gone = steps.where("kind = 'remove_edge'")
    # the k-th removal of some ends takes their k-th edge by arrival: those there before, then those made on the way
    named = edges.join(gone.select(*ends).distinct(), ends, "left_semi")
    lined = named.select("id", *ends, F.col("ord").alias("_ord"), F.lit(0).alias("_new")).unionByName(made.join(gone.select(*ends).distinct(), ends, "left_semi").select("id", *ends, F.col("seq").alias("_ord"), F.lit(1).alias("_new")))
    place = F.row_number().over(Window.partitionBy(*ends).orderBy("_new", "_ord", "id"))
    nth = F.row_number().over(Window.partitionBy(*ends).orderBy("seq"))
    taken = settled(lined.withColumn("_n", place).join(gone.withColumn("_n", nth).select(*ends, "_n", F.col("seq")), [*ends, "_n"]).select("id", *ends, "_ord", "_new", "seq"))
    old_gone = taken.where("_new = 0").select("id", *ends, F.col("_ord").alias("ord"))
    kept = edges.join(old_gone, ["id", *ends, "ord"], "left_anti").select("id", "type", "source_id", "target_id", "ord")
    newest = edges.agg(F.max("ord")).first()[0] or 0
    stay = made.join(taken.where("_new = 1").select(F.col("_ord").alias("seq")), "seq", "left_anti")
    added = stay.select("id", "type", "source_id", "target_id", (F.lit(newest) + F.col("seq") + 1).alias("ord"))
    nothing = F.lit(None).cast(ups.schema["state"].dataType)
    events = ups.where("action <> 'none'").select("seq", F.when(F.col("action") == "create", "NodeCreated").otherwise("NodeUpdated").alias("kind"), F.col("id").alias("entity_id"), F.col("before"), F.col("state").alias("after"))
    events = events.unionByName(made.select("seq", F.lit("EdgeCreated").alias("kind"), F.col("id").alias("entity_id"), nothing.alias("before"), nothing.alias("after")))
    events = events.unionByName(taken.select("seq", F.lit("EdgeRemoved").alias("kind"), F.col("id").alias("entity_id"), nothing.alias("before"), nothing.alias("after")))
    return {"nodes": new_nodes, "edges": kept.unionByName(added.withColumn("ord", F.col("ord").cast(kept.schema["ord"].dataType))), "events": events, "errors": errors}


def graph_at(log: DataFrame, moment: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) as the log (entity_id, entity_type, ts, seq, state) has them at a time; edges are entities of types Relationship:..."""
    past = log.where(F.col("ts") <= F.lit(moment).cast("timestamp_ntz"))
    last = past.groupBy("entity_id", "entity_type").agg(F.max(F.struct("ts", "seq", "state")).alias("_l")).select("entity_id", "entity_type", F.col("_l.state").alias("state")).where("state is not null")
    is_edge = F.col("entity_type").startswith("Relationship:")
    return last.where(~is_edge), last.where(is_edge).withColumn("type", F.substring_index("entity_type", ":", -1))


def rolled_back(nodes: DataFrame, edges: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, events) without what a run created (column run_id): its edges first, then its nodes with all their edges."""
    mine: Column = F.col("run_id").eqNullSafe(F.lit(run_id))
    gone = nodes.where(mine).select("id").distinct()
    end = lambda c: F.col(c).alias("id")
    at = edges.select(F.col("id").alias("edge"), F.explode(F.array("source_id", "target_id")).alias("id")).join(gone, "id", "left_semi").select(F.col("edge").alias("id")).distinct()
    cut = settled(edges.where(mine).select("id").unionByName(at).distinct())
    events = cut.select(F.lit(1).alias("step"), F.lit("EdgeRemoved").alias("kind"), end("id")).unionByName(gone.select(F.lit(2).alias("step"), F.lit("NodeRetired").alias("kind"), end("id")))
    return nodes.where(~mine), edges.join(cut, "id", "left_anti"), events
