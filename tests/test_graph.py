import pytest
from pyspark.sql import functions as F

from skein.operators import graph, lookup


@pytest.fixture(scope="module")
def g(spark):
    nodes = spark.createDataFrame([(i, t, i.upper()) for i, t in [("a", "X"), ("b", "Y"), ("c", "X"), ("d", "X"), ("e", "Z"), ("z", "X")]], "id string, type string, name string")
    edges = spark.createDataFrame(
        [("1", "t", "a", "b"), ("2", "t", "b", "c"), ("3", "u", "a", "c"), ("4", "t", "c", "a"), ("5", "t", "c", "d"), ("6", "u", "d", "d"), ("7", "t", "d", "gone"), ("8", "t", "a", "b")],
        "id string, type string, source_id string, target_id string",
    )
    return nodes, edges


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def test_traverse_clauses(g):
    nodes, edges = g
    start = nodes.where("id = 'a'")
    reached, seen = graph.traverse(nodes, edges, start, depth=1)
    assert {r["id"]: r["depth"] for r in reached.collect()} == {"a": 0, "b": 1, "c": 1} and ids(seen, "edge_id") == ["1", "3", "8"]
    reached, seen = graph.traverse(nodes, edges, start, depth=3)
    assert ids(reached) == ["a", "b", "c", "d"] and "gone" not in ids(reached)
    assert ids(seen, "edge_id") == ["1", "2", "3", "4", "5", "6", "7", "8"]
    # the start is not filtered, and nothing is walked through a node of another type
    reached, _ = graph.traverse(nodes, edges, start, node_types=["X"], kinds=["t"], depth=5)
    assert ids(reached) == ["a"]
    assert ids(graph.traverse(nodes, edges, start, "in", depth=1)[0]) == ["a", "c"]
    assert ids(graph.traverse(nodes, edges, nodes.where("id = 'd'"), "both", depth=1)[0]) == ["c", "d"]
    assert graph.traverse(nodes, edges, nodes.where("id = 'q'"))[0].count() == 0
    assert ids(graph.traverse(nodes, edges, start, depth=0)[0]) == ["a"]


def test_simple_paths(g):
    _, edges = g
    found = [(r["nodes"], r["edge_ids"]) for r in graph.simple_paths(edges, "a", "c").collect()]
    assert found == [(["a", "c"], ["3"]), (["a", "b", "c"], ["1", "2"]), (["a", "b", "c"], ["8", "2"])]
    assert graph.simple_paths(edges, "a", "a").count() == 0 and graph.simple_paths(edges, "d", "a").count() == 0
    assert graph.simple_paths(edges, "a", "c", limit=1).count() == 1


def test_components_match_union_find(spark):
    import random

    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_cuts_cycles_and_marks_orphans(spark):
    rows = [("r", None), ("k", "r"), ("k2", "k"), ("orphan", "nowhere"), ("self", "self"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("tail", "c2")]
    out = {r["id"]: (r["parent"], r["orphaned"]) for r in graph.forest(spark.createDataFrame(rows, "id string, parent string")).collect()}
    assert out == {"r": (None, False), "k": ("r", False), "k2": ("k", False), "orphan": (None, True), "self": (None, True), "c1": ("c2", False), "c2": ("c3", False), "c3": (None, False), "tail": ("c2", False)}
    tree = spark.createDataFrame(rows, "id string, parent string")
    counts = {r["id"]: r["descendants"] for r in graph.descendant_counts(graph.forest(tree)).collect()}
    assert counts["r"] == 2 and counts["c3"] == 3 and counts["tail"] == 0
    paths = {r["id"]: r["path"] for r in graph.with_paths(graph.forest(tree).withColumn("name", F.col("id"))).collect()}
    assert paths["k2"] == ["r", "k", "k2"] and paths["tail"] == ["c3", "c2", "tail"]


def test_deep_chains_and_long_cycles(spark):
    chain = [(f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(150)]
    ring = [(f"z{i:03d}", f"z{(i + 1) % 300:03d}") for i in range(300)]
    deep = spark.createDataFrame(chain, "id string, parent string")
    pairs = {(r["ancestor"], r["id"], r["distance"]) for r in graph.closure(graph.forest(deep)).collect()}
    assert pairs == {(f"n{a:03d}", f"n{b:03d}", b - a) for b in range(150) for a in range(b + 1)}
    assert {r["id"]: r["descendants"] for r in graph.descendant_counts(deep).collect()} == {f"n{i:03d}": 149 - i for i in range(150)}
    assert {r["id"]: len(r["path"]) for r in graph.with_paths(deep.withColumn("name", F.col("id"))).collect()} == {f"n{i:03d}": i + 1 for i in range(150)}
    both = spark.createDataFrame(chain + ring + [("zz", "z007"), ("zzz", "zz")], "id string, parent string")
    assert {r["id"]: r["parent"] for r in graph.forest(both).collect()} == dict(chain + ring) | {"z299": None, "zz": "z007", "zzz": "zz"}
    with pytest.raises(ValueError, match="not a forest"):
        graph.closure(spark.createDataFrame(ring[:2] + [("z002", "z000")], "id string, parent string"))


def test_impact_prunes_and_keeps_the_best(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 0.5), ("a", "c", 1.0, 1.0), ("c", "b", 1.0, 1.0), ("b", "d", 0.1, 1.0)], "source_id string, target_id string, strength double, confidence double")
    out = {r["id"]: (round(r["score"], 6), r["distance"]) for r in graph.impact(edges, "a", 1.0, 3, 0.1).collect()}
    assert out == {"c": (round(1 / 1.3, 6), 1), "b": (round(1 / 1.6, 6), 2)}


def test_induced_merge_degrees(g):
    nodes, edges = g
    assert ids(graph.induced(nodes.where("type = 'X'"), edges)) == ["3", "4", "5", "6"]
    assert graph.merged(nodes, nodes.where("id = 'a'")).count() == nodes.count()
    assert {r["id"]: r["degree"] for r in graph.degrees(edges).collect()}["d"] == 4


# --- lookups --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def listing(spark):
    rows = [(f"e{i:03d}", "T", None if i % 10 == 3 else i % 7) for i in range(60)] + [("x", "U", 1)]
    return spark.createDataFrame(rows, "id string, type string, rank int")


@pytest.mark.parametrize("descending", [False, True])
def test_pages_follow_the_whole_order(listing, descending):
    whole = [r["id"] for r in listing.where("type = 'T'").orderBy(*lookup.order("rank", descending)).collect()]
    seen, cursor, sizes = [], None, []
    while True:
        page = lookup.list_entries(listing, "T", sort="rank", descending=descending, limit=25, cursor=cursor)
        seen += [r["id"] for r in page["items"]]
        sizes.append(len(page["items"]))
        assert page["total"] == 60
        cursor = page["cursor"]
        if not page["has_more"]:
            break
    assert seen == whole and sizes == [25, 25, 10] and cursor is None


def test_listing_edges_of_the_contract(listing, g):
    assert lookup.list_page(listing, None).count() == 0 and lookup.list_entries(listing, None)["items"] == []
    assert [lookup.page_size(x) for x in (None, 0, -3, 7.9, 1000)] == [25, 1, 1, 7, 100]
    with pytest.raises(ValueError, match="malformed"):
        lookup.decode_cursor("%%%")
    assert lookup.decode_cursor(lookup.encode_cursor(None, "é")) == (None, "é")
    assert lookup.find_by_type(listing, "T", [("rank", "neq", 3)]).where("rank is null").count() == 6
    with pytest.raises(ValueError, match="operator"):
        lookup.matches("rank", "like", 1)
    nodes, edges = g
    assert lookup.exists(nodes, "a") and not lookup.exists(nodes, "q")
    assert ids(lookup.edges_of(edges, "d")) == ["5", "6", "7"]
    rows = {tuple(r) for r in lookup.entry_detail(nodes, edges, "d").collect()}
    assert rows == {("u", "out", "d", "D"), ("t", "out", "gone", "gone"), ("t", "in", "c", "C")}


def test_facets(listing):
    out = {(r["facet"], r["value"]): r["n"] for r in lookup.facet_counts(listing, ["type", "rank"]).collect()}
    assert out[("type", "T")] == 60 and out[("rank", None)] == 6 and out[("rank", "1")] == 9
