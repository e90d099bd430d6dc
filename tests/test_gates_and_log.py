import pytest
from pyspark.sql import functions as F

from skein.operators import gates, temporal


def test_link_gate_order_and_cardinality(spark):
    nodes = spark.createDataFrame([("d", "Decision"), ("r", "Rule"), ("x", "DomainConcept"), ("c1", "BoundedContext"), ("c2", "BoundedContext")], "id string, type string")
    rows = [("1", "evaluates", "d", "r", 1), ("2", "evaluates", "x", "r", 2), ("3", "evaluates", "d", "x", 3), ("4", "belongsTo", "x", "gone", 4), ("5", "belongsTo", "x", "c1", 5), ("6", "belongsTo", "x", "c2", 6), ("7", "unheardOf", "x", "c2", 7), ("8", "belongsTo", None, "c1", 8), ("9", "belongsTo", "r", "c1", 9)]
    edges = spark.createDataFrame(rows, "id string, type string, source_id string, target_id string, ord int")
    old = spark.createDataFrame([("r", "belongsTo")], "source_id string, type string")
    out = {r["id"]: (r["status"], r["reason"]) for r in gates.link_gate(edges, nodes, existing=old).collect()}
    assert out == {"1": ("loaded", None), "2": ("quarantined", "source type"), "3": ("quarantined", "target type"), "4": ("quarantined", "dangling"), "5": ("loaded", None), "6": ("quarantined", "cardinality"), "7": ("loaded", None), "8": ("failed", "missing keys"), "9": ("quarantined", "cardinality")}
    totals = {r["status"]: (r["n"], r["total"]) for r in gates.status_totals(gates.link_gate(edges, nodes)).collect()}
    assert sum(n for n, _ in totals.values()) == 9 == totals["failed"][1]
    rules = gates.Rules().register("unheardOf", ["Decision"])
    assert {r["id"]: r["reason"] for r in gates.link_gate(edges, nodes, rules).collect()}["7"] == "source type"


def test_decision_integrity(spark):
    decisions = spark.createDataFrame([("d1", "automated"), ("d2", "manual"), ("d3", "automated")], "id string, decision_type string")
    edges = spark.createDataFrame([("evaluates", "d2", "r"), ("produces", "d2", "e"), ("triggeredBy", "e", "d3"), ("evaluates", "d3", "r"), ("produces", "d3", "e")], "type string, source_id string, target_id string")
    assert {r["id"]: len(r["violations"]) for r in gates.decision_integrity(decisions, edges).collect()} == {"d1": 3, "d2": 0, "d3": 0}


def test_emit_gate_and_schema(spark):
    rows = spark.createDataFrame([(1, 0.5, "a", ["x"]), (2, 0.49, "a", ["x"]), (3, None, "a", ["x"]), (4, 0.9, None, ["x"]), (5, 0.9, "q", ["x"]), (6, 0.9, "a", [])], "id int, confidence double, kind string, items array<string>")
    valid = gates.schema_check({"required": ["kind"], "properties": {"kind": {"enum": ["a", "b"], "minLength": 1}, "items": {"minItems": 1}, "confidence": {"minimum": 0, "maximum": 1}}, "allOf": [{"required": ["items"]}]})
    assert {r["id"]: r["reason"] for r in gates.emit_gate(rows, 0.5, valid).collect()} == {1: None, 2: "confidence", 3: "confidence", 4: "shape", 5: "shape", 6: "shape"}
    assert rows.select(gates.missing_fields(["kind", "confidence"]).alias("m")).where("size(m) > 0").count() == 2


def test_lifecycle(spark):
    pairs = spark.createDataFrame([("draft", "active"), ("retired", "active"), (None, "draft"), ("active", "active")], "a string, b string")
    assert [r[0] for r in pairs.select(gates.lifecycle_allowed(F.col("a"), F.col("b"))).collect()] == [True, False, True, True]


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "2024-01-01 00:00:00", 1, "new"), (1, "2024-01-02 00:00:00", 2, "new"), (1, "2024-01-03 00:00:00", 3, "old"), (2, "2024-01-02 00:00:00", 4, "x"), (2, "2024-01-02 00:00:00", 5, None), (3, "2024-01-03 00:00:00", 6, "y")]
    return spark.createDataFrame(rows, "entity_id long, ts string, seq long, state string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_versions_skip_repeats(log):
    out = [(r["entity_id"], r["revision"], r["state"], r["tx_to"] is None) for r in temporal.versions(log).orderBy("entity_id", "revision").collect()]
    assert out == [(1, 1, "new", False), (1, 2, "old", True), (2, 1, "x", False), (2, 2, None, True), (3, 1, "y", True)]


def test_state_and_difference(log):
    assert {tuple(r) for r in temporal.state_at(log, "2024-01-02 00:00:00").collect()} == {(1, "new")}
    assert {tuple(r) for r in temporal.difference(log, "2024-01-01 12:00:00", "2024-01-03 00:00:00").collect()} == {(1, "changed"), (3, "added")}
    assert temporal.in_range(log, "2024-01-02 00:00:00", "2024-01-03 00:00:00").count() == 5
    assert temporal.in_range(log, state="y").count() == 1


def test_upsert(spark):
    current = spark.createDataFrame([("a", 3, "s"), ("b", 1, "t"), ("c", 2, "u")], "id string, revision int, state string")
    new = spark.createDataFrame([("a", "s2", 3), ("b", "t", None), ("c", "v", 1), ("d", "w", None)], "id string, state string, expected_revision int")
    out = {r["id"]: (r["action"], r["revision"], r["state"]) for r in temporal.upsert(current, new, expected=True).collect()}
    assert out == {"a": ("update", 4, "s2"), "b": ("none", 1, "t"), "c": ("conflict", 2, "u"), "d": ("create", 1, "w")}


def test_retire_and_remove(spark):
    nodes = spark.createDataFrame([("a", 1, "active", None), ("b", 1, "retired", "x")], "id string, revision int, lifecycle_status string, valid_to string")
    out = {r["id"]: (r["revision"], r["lifecycle_status"], r["valid_to"]) for r in temporal.retired(nodes, nodes.select("id"), "now").collect()}
    assert out == {"a": (2, "retired", "now"), "b": (1, "retired", "x")}
    edges = spark.createDataFrame([("1", "a", "b"), ("2", "b", "c"), ("3", "c", "c")], "id string, source_id string, target_id string")
    kept, left, events = temporal.removed(nodes, edges, nodes.where("id = 'a'"))
    assert kept.count() == 1 and [r["id"] for r in left.orderBy("id").collect()] == ["2", "3"]
    assert {(r["kind"], r["entity_id"], r["step"]) for r in events.collect()} == {("EdgeRemoved", "1", 1), ("NodeRetired", "a", 2)}


def test_clock_is_strictly_monotonic(spark):
    rows = temporal.clocked(spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "entity_id string, ord int"), "2024-01-01 00:00:00")
    a = [r["ts"] for r in rows.where("entity_id = 'a'").orderBy("ord").collect()]
    assert a[0] < a[1] and (a[1] - a[0]).total_seconds() == 0.001


def test_replay_and_rollback(spark):
    rows = spark.createDataFrame([("r1", "e1"), ("r1", "e2"), (None, "e3")], "run_id string, entry_id string")
    assert gates.not_replayed(rows, rows.where("entry_id = 'e1'")).count() == 2
    assert gates.rolled_back(rows, "r1").count() == 1
