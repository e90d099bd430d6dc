import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from skein.operators import realisation
from skein.plans import views
from skein.plans.tables import shared_dir
from skein.plans.upkeep import EDGE, MAPPING, NODE, Upkeep


def rows(df, *cols):
    return sorted((tuple(map(str, r)) for r in df.select(*cols).collect()), key=str)


def test_views_equal_recomputation(spark, tmp_path):
    """Random batches of nodes, edges and mappings that come, go and change type, against the views computed anew."""
    rng = random.Random(11)
    kinds = ["DomainConcept", "Service", "BoundedContext", "BusinessCapability", "Subdomain"]
    nodes, edges, maps = {}, {}, {}
    kept = Upkeep(spark, str(tmp_path / "state"), buckets=3)
    for number in range(1, 4):
        dn, de, dm = [], [], []
        for _ in range(14):
            i = f"n{rng.randrange(18)}"
            if i in nodes:
                dn.append((i, *nodes.pop(i), -1))
            if rng.random() < 0.8:
                nodes[i] = (rng.choice(kinds), f"name {i}")
                dn.append((i, *nodes[i], 1))
        for _ in range(25):
            i = f"e{rng.randrange(60)}"
            if i in edges:
                de.append((i, *edges.pop(i), -1))
            if rng.random() < 0.8:
                edges[i] = (rng.choice(["belongsTo", "belongsTo", "fulfils", "implements", "specifies", "x"]), f"n{rng.randrange(18)}", f"n{rng.randrange(18)}")
                de.append((i, *edges[i], 1))
        for _ in range(6):
            i = f"m{rng.randrange(9)}"
            if i in maps:
                dm.append((i, *maps.pop(i), -1))
            if rng.random() < 0.8:
                maps[i] = (f"n{rng.randrange(18)}", rng.choice(["full", "partial", "odd"]))
                dm.append((i, *maps[i], 1))
        make = lambda changed, kind: spark.createDataFrame(changed, f"{kind}, m int")
        assert kept.apply(number, make(dn, NODE), make(de, EDGE), make(dm, MAPPING))
        if number < 3:
            continue
        n = spark.createDataFrame([(i, *v) for i, v in nodes.items()], NODE)
        e = spark.createDataFrame([(i, *v) for i, v in edges.items()], EDGE)
        m = spark.createDataFrame([(i, *v) for i, v in maps.items()], MAPPING)
        assert rows(kept.context_counts(), "id", "concepts", "services") == rows(views.context_counts(n, e), "id", "concepts", "services")
        links = views.cross_context(n, e)
        assert rows(kept.cross_context(), "source", "target", "type", "strength") == rows(links, "source", "target", "type", "strength")
        assessed = realisation.elements(n.where(F.col("type").isin("DomainConcept", "BusinessCapability")), e, m).withColumn("status", realisation.row_status())
        columns = ["id", "fulfils", "specifies", "technical", "incoming", "any_full", "any_mapped", "functional", "is_technical", "status"]
        assert rows(kept.coverage(), *columns) == rows(assessed, *columns)
        assert rows(kept.gaps(), "id", "name", "missing", "priority", "reason") == rows(realisation.gaps(assessed), "id", "name", "missing", "priority", "reason")


def test_batches_once_and_touched_buckets_only(spark, tmp_path):
    kept = Upkeep(spark, str(tmp_path / "state"), 4)
    many = spark.range(400).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("DomainConcept").alias("type"), F.lit("x").alias("name"), F.lit(1).alias("m"))
    assert kept.apply(1, many) and not kept.apply(1, many)
    before = dict(kept._where["nodes"])
    one = spark.createDataFrame([("c7", "DomainConcept", "x", -1), ("c8", "DomainConcept", "x", 1), ("c8", "DomainConcept", "x", -1)], f"{NODE}, m int")
    assert kept.apply(2, one)
    changed = [b for b, p in kept._where["nodes"].items() if before.get(b) != p]
    assert len(changed) <= 1 and kept.coverage().count() == 399
    again = Upkeep(spark, str(tmp_path / "state"), 4)
    assert again.version == 2 and again.coverage().count() == 399
    assert again.apply(3) and again.apply(9)
    engine = views.Engine()
    engine.keep("coverage", kept, kept.coverage)
    assert engine.get("coverage")["entries_included"] == 399 and engine.version("coverage") == 2 and not engine.get("coverage")["stale"]
    engine.announce(9)
    assert engine.get("coverage")["stale"]
    engine.refresh("coverage")
    assert not engine.get("coverage")["stale"] and engine.version("coverage") == 9
    again.vacuum()
    assert Upkeep(spark, str(tmp_path / "state"), 4).coverage().count() == 399
    stale = Upkeep(spark, str(tmp_path / "state"), 4)
    again.apply(10, one)
    with pytest.raises(Exception, match="already exists"):  # two writers of one number: one of them wins
        stale.apply(10, one)


def test_only_named_views_are_kept_up(spark, tmp_path):
    nodes = spark.createDataFrame([("n1", "BoundedContext", "x", 1), ("c1", "DomainConcept", "x", 1)], f"{NODE}, m int")
    edges = spark.createDataFrame([("e1", "belongsTo", "c1", "n1", 1)], f"{EDGE}, m int")
    kept = Upkeep(spark, str(tmp_path / "state"), 2, views=("contexts",))
    assert kept.apply(1, nodes, edges)
    assert [tuple(r) for r in kept.context_counts().collect()] == [("n1", 1, 0)]
    assert not (tmp_path / "state" / "links").exists() and not (tmp_path / "state" / "elements").exists()
    with pytest.raises(ValueError, match="not kept up"):
        kept.coverage()


def test_queries_join_the_trades_once(spark, monkeypatch):
    from skein import registry_more
    from skein.plans import tables

    written = []
    monkeypatch.setattr(registry_more, "settled", lambda df, label: (written.append(label), tables.settled(df, label))[1])
    registry_more.upkept_contexts(spark, "/root/testdata/sf0.001")
    assert written == ["edges"]


def test_batches_leave_only_the_tables(spark, tmp_path):
    """Steps of a batch go with it, and a vacuum that keeps one version leaves no other."""
    left = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:")).iterdir()}
    before = left()
    nodes = spark.createDataFrame([("n1", "BoundedContext", "x", 1), ("n2", "BoundedContext", "x", 1), ("c1", "DomainConcept", "x", 1), ("s1", "Service", "x", 1)], f"{NODE}, m int")
    edges = spark.createDataFrame([("e1", "belongsTo", "c1", "n1", 1), ("e2", "belongsTo", "s1", "n2", 1), ("e3", "consumes", "c1", "s1", 1)], f"{EDGE}, m int")
    kept = Upkeep(spark, str(tmp_path / "state"), 1, views=("links",))
    assert kept.apply(1, nodes, edges) and kept.apply(2, edges=edges.where("id = 'e3'").withColumns({"id": F.lit("e4")}))
    assert left() == before
    kept.vacuum(1)
    assert [tuple(r) for r in kept.cross_context().collect()] == [("n1", "n2", "consumes", 2)]
    assert [p.name for p in (tmp_path / "state" / "manifests").iterdir() if p.name.isdigit()] == ["2"]
    assert not list((tmp_path / "state" / "edges_out" / "1").glob("_bucket=*"))
