import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.sources.files import ENTRY
from skein.streaming.loader import Loader, Loaders, linked, load_into


def node(i, kind="DomainConcept"):
    return {"id": i, "type": kind, "version": "1", "source": {"file": "f"}, "confidence": 0.9, "data": {"name": i}}


def edge(i, s, t, kind="relatesTo"):
    return {"id": i, "type": "Relationship", "version": "1", "source": {"file": "f"}, "confidence": 0.9, "data": {"relationshipType": kind, "sourceEntityId": s, "targetEntityId": t}}


def entries(spark, *rows, run="r1"):
    lines = spark.createDataFrame([(json.dumps(r),) for r in rows], "value string")
    return lines.select(F.from_json("value", ENTRY).alias("e")).select("e.*").withColumn("run_id", F.lit(run))


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_edges_wait_for_their_ends(spark, tmp_path):
    one = Loader(spark, str(tmp_path / "one"), buckets=2)
    first = entries(spark, edge("e1", "a", "b"), edge("e2", "b", "c"), node("a"), node("a"), edge("bad", "a", ""), edge("e3", "a", "a"))
    assert one.load(first, datetime(2024, 1, 1)) == {"loaded": 2, "dangling": 2, "failed": 1, "skipped": 1}
    assert ids(one.edges()) == ["e3"] and {(r["id"], r["missing"]) for r in one.waiting().collect()} == {("e1", "b"), ("e2", "b")}
    # the node that e1 waits for comes; e2 goes on waiting for its other end; the run is sent again as a whole
    assert one.load(entries(spark, node("b"), edge("e1", "a", "b"), edge("e2", "b", "c")), datetime(2024, 1, 2)) == {"loaded": 2, "dangling": 1, "skipped": 2}
    assert ids(one.edges()) == ["e1", "e3"] and [(r["id"], r["missing"], r["since"].day) for r in one.waiting().collect()] == [("e2", "c", 1)]
    # another reader opens what is there; time runs out for what still waits, and its node comes too late
    again = Loader(spark, str(tmp_path / "one"), buckets=2)
    assert again.expire(datetime(2024, 1, 1)) == {} and again.expire(datetime(2024, 1, 3)) == {"quarantined": 1}
    assert again.load(entries(spark, node("c"))) == {"loaded": 1} and ids(again.edges()) == ["e1", "e3"] and again.waiting().isEmpty()
    assert ids(again.nodes()) == ["a", "b", "c"]
    story = sorted((r["version"], r["status"]) for r in again.statuses().where("entry_id = 'e2'").collect())
    assert story == [(1, "dangling"), (2, "dangling"), (2, "skipped"), (4, "quarantined")]
    # what failed may come again, mended
    assert again.load(entries(spark, edge("bad", "a", "b"))) == {"loaded": 1}


def test_named_loaders_and_replay(spark, tmp_path):
    class Broken(Loader):
        broken = True

        def load(self, batch, at=None):
            if self.broken:
                raise RuntimeError("store is down")
            return super().load(batch, at)

    loaders = {"good": Loader(spark, str(tmp_path / "good"), buckets=2), "bad": Broken(spark, str(tmp_path / "bad"), buckets=2)}
    all_of_them = Loaders(spark, str(tmp_path / "all"), loaders)
    run = entries(spark, node("a"), node("b"), edge("e", "a", "b")).drop("run_id")
    states = all_of_them.run(run, "r1")
    assert states["good"] == "completed" and "store is down" in states["bad"] and states["state"] == "failed"
    loaders["bad"].broken = False
    assert all_of_them.replay("bad", run, "r1") == {"loaded": 3}
    assert all_of_them.replay("good", run, "r1") == {"skipped": 3}
    assert {r["loader"]: r["state"] for r in all_of_them.status("r1").collect()} == {"good": "completed", "bad": "completed"}
    assert ids(loaders["bad"].edges()) == ids(loaders["good"].edges()) == ["e"]
    with pytest.raises(ValueError, match="no loader named"):
        all_of_them.replay("other", run, "r1")


def test_stream_of_entries(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[edge("e1", "a", "b"), node("a")], [node("b"), edge("e1", "a", "b")], [edge("e2", "b", "a")]]
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(r | {"run_id": "r"}) for r in rows))
    schema = T.StructType([*ENTRY.fields, T.StructField("run_id", T.StringType())])
    one = Loader(spark, str(tmp_path / "one"), buckets=2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    load_into(stream, one, str(tmp_path / "cp")).awaitTermination(300)
    assert ids(one.edges()) == ["e1", "e2"] and one.waiting().isEmpty() and one.version == 3


def test_stream_join_equals_the_table_join(spark, tmp_path):
    """Edges meet their ends within an hour; after the watermark has passed, the others come out as quarantined."""
    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    nodes = [("a", at(1)), ("b", at(1, 30)), ("c", at(4)), ("x", at(9)), ("y", at(9))]
    edges = [("e1", "t", "a", "b", at(1, 10)), ("e2", "t", "a", "c", at(1, 20)), ("e3", "t", "gone", "c", at(4, 30)), ("e4", "t", "x", "y", at(9, 1))]
    n, e = "id string, ts timestamp", "id string, type string, source_id string, target_id string, ts timestamp"
    want = {(r["id"], r["status"], tuple(r["unmet"])) for r in linked(spark.createDataFrame(edges, e), spark.createDataFrame(nodes, n)).collect()}
    assert want == {("e1", "linked", ()), ("e2", "quarantined", ("target",)), ("e3", "quarantined", ("source",)), ("e4", "linked", ())}
    # rows far ahead only move the watermarks on
    far = [[nodes[:2], edges[:2]], [nodes[2:], edges[2:]], [[("z", at(20))], [("e9", "t", "z", "z", at(20))]], [[("z2", at(23))], [("e10", "t", "z2", "z2", at(23))]]]
    for i, (some, others) in enumerate(far):
        spark.createDataFrame(some, n).coalesce(1).write.mode("append").parquet(str(tmp_path / "n"))
        spark.createDataFrame(others, e).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
        read = lambda name, kind: spark.readStream.schema(kind).parquet(str(tmp_path / name))
        query = linked(read("e", e), read("n", n)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(300)
    found = {(r["id"], r["status"], tuple(r["unmet"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {f for f in found if f[0] in ("e1", "e2", "e3", "e4")} == want
