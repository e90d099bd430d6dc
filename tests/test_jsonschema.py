import json

import pytest
from pyspark.sql import functions as F

from skein.functions.jsonschema import breach, completeness

PERSON = {
    "$defs": {"place": {"type": "object", "required": ["city"], "properties": {"city": {"type": "string", "minLength": 2}, "within": {"$ref": "#/$defs/place"}}}},
    "type": "object",
    "required": ["name", "age"],
    "additionalProperties": False,
    "properties": {
        "name": {"type": "string", "pattern": "^[A-Z]", "maxLength": 5},
        "age": {"type": "integer", "minimum": 0, "exclusiveMaximum": 150},
        "home": {"$ref": "#/$defs/place"},
        "tags": {"type": "array", "minItems": 1, "maxItems": 3, "items": {"enum": ["a", 1, None, True, [1, 2], {"k": "v"}]}},
        "kind": {"oneOf": [{"const": "x"}, {"type": "string", "minLength": 2}]},
        "any": {"anyOf": [{"type": "number", "multipleOf": 5}, {"type": ["boolean", "null"]}]},
        "not": {"not": {"type": "string"}},
        "more": {"type": "object", "additionalProperties": {"type": "number"}},
        "a.b": {"allOf": [{"type": "number"}, {"minimum": 3}]},
        "none": False,
    },
    "if": {"properties": {"age": {"minimum": 100}}},
    "then": {"required": ["home"]},
    "else": {"properties": {"name": {"not": {"const": "Old"}}}},
}
OK = {"name": "Ann", "age": 3}
CASES = [
    (OK, None), (OK | {"age": 3.0}, None), ({"age": 1}, "$.name: required"), ([], "$: type"), ("x", "$: type"), (None, "$: type"),
    (OK | {"name": "ann"}, "$.name: pattern"), (OK | {"name": "Annabel"}, "$.name: maxLength"), (OK | {"name": 5}, "$.name: type"), (OK | {"age": "3"}, "$.age: type"),
    (OK | {"age": 3.5}, "$.age: type"), (OK | {"age": -1}, "$.age: minimum"), (OK | {"age": 150}, "$.age: exclusiveMaximum"), (OK | {"zip": 1, "b": 2}, "$.b: additionalProperties"),
    (OK | {"home": {"city": "X"}}, "$.home.city: minLength"), (OK | {"home": {}}, "$.home.city: required"), (OK | {"home": {"city": "XY", "within": {"city": 7}}}, "$.home.within.city: type"),
    (OK | {"tags": []}, "$.tags: minItems"), (OK | {"tags": ["a", 1.0, None]}, None), (OK | {"tags": [True, [1, 2], {"k": "v"}]}, None), (OK | {"tags": ["a", "b"]}, "$.tags[1]: enum"), (OK | {"tags": ["a"] * 4}, "$.tags: maxItems"),
    (OK | {"kind": "x"}, None), (OK | {"kind": "xx"}, None), (OK | {"kind": "y"}, "$.kind: oneOf"), (OK | {"any": 10}, None), (OK | {"any": None}, None), (OK | {"any": 7}, "$.any: anyOf"),
    (OK | {"not": "s"}, "$.not: not"), (OK | {"not": 1}, None), (OK | {"more": {"p": 1, "q": "z"}}, "$.more.q: type"), (OK | {"a.b": 2}, "$.a.b: minimum"), (OK | {"a.b": 3}, None), (OK | {"none": 1}, "$.none: false"),
    (OK | {"age": 120}, "$.home: required"), (OK | {"name": "Old"}, "$.name: not"),
]


def test_breaches(spark):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, (v, _) in enumerate(CASES)], "id int, s string").withColumn("v", F.parse_json("s"))
    found = {r["id"]: r["b"] for r in rows.select("id", breach(PERSON, F.col("v")).alias("b")).collect()}
    assert {CASES[i][0].__repr__(): b for i, b in found.items()} == {v.__repr__(): want for v, want in CASES}
    assert spark.range(1).select(breach(PERSON, F.lit(None).cast("variant")).alias("b")).first()["b"] is None
    for odd in ({"frobnicate": 1}, {"$ref": "http://x/y"}):
        with pytest.raises(ValueError):
            breach(odd, F.col("v"))


def test_completeness_takes_the_required_fields(spark):
    values = [{"name": "A", "age": 1}, {"name": "", "age": 0}, {"name": None}, {"name": [], "age": [0]}, 5]
    rows = spark.createDataFrame([(json.dumps(v),) for v in values], "s string").withColumn("v", F.parse_json("s"))
    assert [r["c"] for r in rows.select(completeness(PERSON["required"], F.col("v")).alias("c")).collect()] == [1.0, 0.5, 0.0, 0.5, 0.0]
    assert rows.select(completeness([], F.col("v")).alias("c")).first()["c"] == 1.0


def test_schemas_of_a_folder(spark, tmp_path):
    from skein.sources.schemas import Schemas

    (tmp_path / "L1").mkdir()
    for kind, required in (("A", ["name", "size"]), ("B", ["name"])):
        (tmp_path / "L1" / f"{kind}.schema.json").write_text(json.dumps({"$id": kind, "type": "object", "properties": {"type": {"const": kind}, "size": {"type": "integer"}}, "allOf": [{"required": required}]}))
    known = Schemas(str(tmp_path))
    rows = [("A", {"type": "A", "name": "n"}), ("A", {"type": "A", "name": "n", "size": 1.5}), ("B", {"type": "B", "name": "n"}), ("C", {})]
    df = spark.createDataFrame([(t, json.dumps(v)) for t, v in rows], "type string, s string").withColumn("data", F.parse_json("s"))
    found = [tuple(r) for r in df.select(known.breach(F.col("data")), known.completeness(F.col("data"))).collect()]
    assert found == [("$.size: required", 0.5), ("$.size: type", 1.0), (None, 1.0), ("no schema of this type", None)]
