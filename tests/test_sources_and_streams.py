import json
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import gates
from skein.sources import files
from skein.streaming import ingest


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub" / "drafts").mkdir(parents=True)
    (tmp_path / "a.md").write_text("# A\nx")
    (tmp_path / "sub" / "b.TXT").write_text("b")
    (tmp_path / "sub" / "drafts" / "c.markdown").write_text("c")
    (tmp_path / "sub" / "skip.bin").write_text("n")
    (tmp_path / "j.json").write_text('[{"id": 1}]')
    (tmp_path / "bad.json").write_text("{nope")
    return tmp_path


@pytest.mark.parametrize(("pattern", "yes", "no"), [("*.md", ["a.md"], ["x/a.md", "a.mdx"]), ("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("x/**", ["x/a", "x/b/c"], ["y/a"]), ("a?.md", ["ab.md"], ["a/.md", "a.md"]), ("a+b.(md)", ["a+b.(md)"], ["aab.md"])])
def test_globs(pattern, yes, no):
    r = re.compile(files.glob_regex(pattern))
    assert all(r.match(p) for p in yes) and not any(r.match(p) for p in no)


def test_scans_and_filters(spark, folder):
    root = str(folder)
    rows = {r["name"]: r for r in files.scan_text(spark, root).collect()}
    assert set(rows) == {"a.md", "b.TXT", "c.markdown"} and rows["a.md"]["content_type"] == "markdown" and rows["b.TXT"]["content_type"] == "plaintext"
    assert len({r["id"] for r in rows.values()}) == 3
    names = lambda rules: {r["name"] for r in files.scan_text(spark, root, rules).collect()}
    assert names([("include", "extension", "md")]) == {"a.md"}
    assert names([("exclude", "path", "**/drafts/**")]) == {"a.md", "b.TXT"}
    assert names([("include", "name", "*.md"), ("exclude", "name", "a*")]) == set()
    assert names([("include", "tag", "x")]) == set()
    assert {r["path"].rsplit("/", 1)[1]: r["status"] for r in files.scan_json(spark, root).collect()} == {"j.json": "fetched", "bad.json": "failed"}
    assert files.discover(spark, root, "*.bin").count() == 1
    pages = files.scan_pages(spark, root, lambda b: [b.decode(), ""] if b == b"n" else [], "*.bin").first()
    assert pages["content"] == "# skip\n\n## Page 1\n\nn"
    swept = files.standard_connectors()
    assert swept.list() == ["filesystem", "json"] and swept.sweep(spark, root).count() == 5
    with pytest.raises(ValueError, match="already"):
        swept.register("json", files.scan_json)


def test_incremental(spark):
    found = spark.createDataFrame([("same", 1, 10, "h1"), ("touched", 2, 10, "h2"), ("changed", 2, 11, "h9"), ("new", 1, 1, "h4")], "path string, modified int, length int, hash string")
    old = spark.createDataFrame([("same", 1, 10, "h1"), ("touched", 1, 10, "h2"), ("changed", 1, 10, "h3"), ("gone", 1, 1, "h5")], "path string, modified int, length int, hash string")
    status, checkpoint = files.incremental(found, old)
    assert {r["path"]: r["status"] for r in status.collect()} == {"same": "skipped", "touched": "skipped", "changed": "fetched", "new": "fetched"}
    assert checkpoint.count() == 5 and tuple(files.ingest_stats(status).first()) == (2, 2, 0, 4)


def entry(i, confidence=0.9):
    return json.dumps({"id": f"e{i}", "type": "T", "confidence": confidence, "source": {"file": "f"}, "data": {"name": f"n{i}"}})


def test_entries(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text("\n".join([entry(1), "", "{broken", entry(2)]))
    rows = files.read_entries(spark, str(tmp_path), "mark").collect()
    assert [r["id"] for r in rows if r["_corrupt_record"] is None] == ["e1", "e2"] and len(rows) == 3
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        files.read_entries(spark, str(tmp_path), "raise").collect()
    good = files.with_authority(files.read_entries(spark, str(tmp_path)))
    assert good.count() == 2
    assert {r["source"]["sourceAuthority"] for r in good.collect()} == {"operational"}
    names = good.select("id", F.variant_get("data", "$.name", "string").alias("name"))
    files.write_once(names, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_once(names, str(tmp_path / "out"))
    files.manifest(spark, str(tmp_path / "m"), run="r1", n=2)
    assert json.loads(spark.read.text(str(tmp_path / "m")).first()[0]) == {"run": "r1", "n": 2}
    docs = spark.createDataFrame([("x/a.txt",), ("y/a.md",), ("b",)], "path string")
    assert {r["file"] for r in files.companion_names(docs).collect()} == {"a.md", "a-2.md", "b.md"}
    meet = ["x/a.txt", "y/a.txt", "z/a-2.txt", "z/a.md", "q/a-4.md", "a-4-2", "r/a-4.txt", "b/a-3"]
    names = {r["path"]: r["file"] for r in files.companion_names(spark.createDataFrame([(p,) for p in meet], "path string")).collect()}
    assert len(set(names.values())) == len(meet) and names["x/a.txt"] == "a.md" and names["z/a-2.txt"] == "a-2.md" and names["b/a-3"] == "a-3.md"


def test_stream_through_the_gate(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(entry(i, 0.9 if i else 0.1))
    stream = ingest.stream_entries(spark, str(tmp_path / "in"), 1)
    query = ingest.load_stream(stream, lambda df: gates.emit_gate(df).select("id", "status"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    out = {r["id"]: r["status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"e0": "excluded", "e1": "emitted", "e2": "emitted"}


def test_fan_out_is_independent(spark):
    done = []

    def bad(_):
        raise RuntimeError("down")

    got = ingest.fan_out(spark.range(3), {"a": lambda df: done.append(df.count()), "b": bad})
    assert got == {"a": "completed", "b": "failed: down", "state": "partial"} and done == [3]


def test_windows(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", "v", 1.0), (1, "2024-01-01 00:20:00", "v", 2.0), (1, "2024-01-01 01:10:00", "v", 4.0), (2, "2024-01-01 01:10:00", "w", 8.0)], "user_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in ingest.windowed_counts(rows).collect()) == [("v", 1, 4.0), ("v", 2, 3.0), ("w", 1, 8.0)]
    assert ingest.windowed_counts(rows, "1 hour", "30 minutes").count() == 6
    assert sorted((r["user_id"], r["n"]) for r in ingest.sessions(rows).collect()) == [(1, 1), (1, 2), (2, 1)]
    assert ingest.invalidated(spark.createDataFrame([("A",), ("B",)], "entity_type string"), ["A"]).count() == 1
