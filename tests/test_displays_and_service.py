import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators import display, extraction
from skein.plans.service import Service, allowed, seed_paths
from skein.sources import schemas


def test_rows_and_columns(spark):
    rows = spark.createDataFrame([("a", "Event", " ", '{"z": 1, "b": 2}'), ("b", "Event", "B", '{"c": 1, "d": 1}'), ("c", "Odd", None, "{}")], "id string, type string, name string, data string")
    assert {r["id"]: (r["name"], r["layer"]) for r in display.normalised(rows).collect()} == {"a": ("a", "L3"), "b": ("B", "L3"), "c": ("c", "L1")}
    assert display.extra_columns(rows) == [] and display.extra_columns(rows.where("type = 'Event'")) == ["b", "c", "d"]
    assert {r["id"] for r in display.seeds(rows, ["None", "Event", "Odd"]).collect()} == {"a", "b"}


def test_contradictions(spark):
    rows = [("s", "f", "x", "2024-01-01", "2024-02-01", 1, 0.5), ("s", "f", "y", "2024-01-15", None, 2, 0.1), ("t", "f", "x", "2024-01-01", "2024-02-01", 1, 0.5), ("t", "f", "y", "2024-02-01", None, 1, 0.5), ("u", "f", "x", "2024-01-01", "2024-06-01", 1, 0.5), ("u", "f", "x", "2024-02-01", None, 1, 0.5)]
    df = spark.createDataFrame(rows, "subject string, field string, value string, a string, b string, authority int, confidence double").select("subject", "field", "value", F.col("a").cast("timestamp_ntz").alias("valid_from"), F.col("b").cast("timestamp_ntz").alias("valid_to"), "authority", F.col("a").alias("stated_at"), "confidence")
    assert [tuple(r) for r in display.contradictions(df).collect()] == [("s", "f", 2, "y")]


def test_extraction(spark):
    chunks = spark.createDataFrame([("k1", "one two"), ("k2", "")], "id string, content string")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])
    out = extraction.extracted(chunks, lambda text: [{"name": w, "n": len(w)} for w in text.split()], schema)
    assert sorted(tuple(r) for r in out.collect()) == [("k1", "one", 3), ("k1", "two", 3)]
    raw = spark.createDataFrame([("k1", None, "T", "A", "f", "t", None), ("k1", "b", "T", "B", "f", "t", "draft")], "chunk string, id string, type string, name string, source string, fetched_at string, lifecycle_status string")
    built = extraction.build_entities(raw)
    assert built.where("id is null").count() == 0 and {r["lifecycle_status"] for r in built.collect()} == {"active", "draft"}
    links = spark.createDataFrame([("k1", "b", "b"), ("k1", "b", "q"), ("k2", "b", "a")], "chunk string, source_id string, target_id string")
    assert extraction.build_relationships(links, built).count() == 0
    index = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert {tuple(r) for r in extraction.last_write(index, spark.createDataFrame([("b", 2)], "id string, v int")).collect()} == {("a", 1), ("b", 2)}
    prompts = extraction.Prompts()
    prompts.add("p", "1.9.0", "old {name}")
    prompts.add("p", "1.10.0", "new {name}!")
    assert built.where("id = 'b'").select(extraction.prompt(prompts.get("p")).alias("t")).first()["t"] == "new B!" and prompts.get("p", "1.9.0") == "old {name}"


def test_service(spark):
    nodes = spark.createDataFrame([(i, "T", i) for i in "abcd"], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "t", "a", "b"), ("2", "t", "a", "c"), ("3", "t", "b", "d")], "id string, type string, source_id string, target_id string")
    seen = []
    service = Service(nodes, edges, nodes_policy=lambda d: d.where("id <> 'd'"), metrics=seen.append)
    assert service.entry("a")["name"] == "a" and service.entry("d") is None
    found = service.traverse("a", depth=9, limit=2)
    assert [tuple(r) for r in found["nodes"].collect()] == [("a", 0), ("b", 1)] and found["truncated"]
    assert sorted(r[0] for r in found["edges"].collect()) == ["1", "2", "3"]
    assert not service.traverse("a", depth=5, limit=1, with_edges=False)["truncated"]
    paths = service.paths("a", "d")
    assert [r["nodes"] for r in paths["paths"].collect()] == [["a", "b", "d"]] and paths["found"] and len(service.entries("T")["items"]) == 3
    seen.pop(3)
    assert [m["kind"] for m in seen] == ["entityLookup", "entityLookup", "traversal", "pathFinding", "typeListing"]


def test_grants(spark):
    rows = spark.createDataFrame([("1", "A", "x"), ("2", "B", "x"), ("3", "B", "y")], "id string, type string, scope string")
    grants = spark.createDataFrame([("u", "read", "A", "*"), ("u", "*", "B", "y"), ("v", "write", "*", "*")], "user string, action string, kind string, scope string")
    assert {r["id"] for r in allowed(rows, grants, "u").collect()} == {"1", "3"} and allowed(rows, grants, "v").count() == 0


def test_schemas_golden_and_folders(spark, tmp_path):
    (tmp_path / "L1").mkdir()
    schema = {"$id": "one", "properties": {"type": {"const": "Rule"}, "severity": {"enum": ["hard"]}}, "allOf": [{"required": ["id"]}, {"required": ["severity", "id"]}]}
    (tmp_path / "L1" / "rule.schema.json").write_text(json.dumps(schema))
    found = schemas.Schemas(str(tmp_path))
    assert found.types() == ["Rule"] and found.layer("Rule") == "L1" and found.required("Rule") == ["id", "severity"]
    rows = spark.createDataFrame([("1", "Rule", "hard"), ("2", "Rule", "soft"), ("3", "Other", "hard")], "id string, type string, severity string")
    assert [r[0] for r in rows.orderBy("id").select(found.valid()).collect()] == [True, False, False]
    (tmp_path / "L1" / "again.schema.json").write_text(json.dumps(schema))
    with pytest.raises(ValueError, match="two schemas"):
        schemas.Schemas(str(tmp_path))
    (tmp_path / "d.md").write_text("# D")
    (tmp_path / "dataset.json").write_text(json.dumps({"documents": [{"id": "d", "file": "d.md"}], "expectedEntities": [{"type": "T", "name": "N"}], "expectedRelationships": []}))
    docs, kinds, links = schemas.golden(spark, str(tmp_path / "dataset.json"))
    assert docs.first()["content"] == "# D" and kinds.count() == 1 and links.count() == 0
    assert schemas.labels_outside(kinds, "name", ["M"]).count() == 1
    for name in ("stage", "stable"):
        (tmp_path / name).mkdir()
    assert schemas.promote(str(tmp_path / "stage"), str(tmp_path / "stable")).endswith("stable.1") and (tmp_path / "stable").is_dir()
    assert seed_paths(None, None, str(tmp_path / "none"), str(tmp_path)) == [] and seed_paths(["x"], None, None, "") == ["x"]


def test_roles_and_decisions(spark):
    from skein.plans import service

    members = spark.createDataFrame([("u", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("u", "r3"), ("v", None)], "member string, role string")
    held = {(r["user"], r["principal"]): r["distance"] for r in service.held_roles(members).collect()}
    assert {p: d for (u, p), d in held.items() if u == "u"} == {"u": 0, "r1": 1, "r3": 1, "r2": 2}
    with pytest.raises(ValueError, match="nested"):
        service.held_roles(spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(5)], "member string, role string"), most=3)
    grants = [("u", "read", "T", "s", "allow"), ("u", "*", "T", "s", "deny"), ("u", "read", "*", "s", "deny"), ("r1", "read", "T", "x", "deny"), ("r3", "read", "T", "x", "allow"), ("r2", "read", "U", "*", "allow"), ("r1", "write", "U", "*", "deny"), ("r3", "read", "V", "*", "allow"), ("r1", "read", "V", "*", "deny")]
    asked = [(1, "u", "T", "s"), (2, "u", "U", "s"), (3, "u", "T", "x"), (4, "u", "U", "q"), (5, "u", "V", "q"), (6, "u", "W", "q"), (7, "w", "T", "s")]
    rows = service.decided(spark.createDataFrame(asked, "id int, user string, kind string, scope string"), spark.createDataFrame(grants, "principal string, action string, kind string, scope string, effect string"), service.held_roles(members))
    assert {r["id"]: (r["allowed"], r["rule"]) for r in rows.collect()} == {1: (True, "explicit"), 2: (False, "wildcard"), 3: (False, "inherited"), 4: (True, "inherited"), 5: (False, "inherited"), 6: (False, "none"), 7: (False, "none")}
