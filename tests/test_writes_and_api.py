"""The write side against plain Python, gates of edges, requests, the command line, prompts, renders."""

import json
import random

import pytest
from pyspark.sql import functions as F

from skein import cli
from skein.functions import quality as q
from skein.functions import text as tx
from skein.operators import evaluation, extraction, gates, graph, lookup, mapping, resolution, search, store
from skein.plans import api, views
from skein.plans.service import Service
from skein.sources import files

OPS = "seq long, kind string, id string, state string, expected_revision long, type string, source_id string, target_id string"


def applied(nodes, edges, ops, most):
    """What a batch does, one operation after the other: (nodes, edges) or the first error."""
    nodes, edges = dict(nodes), list(edges)
    for seq, kind, i, state, expected, t, a, b in sorted(ops):
        if kind == "upsert":
            revision, old = nodes.get(i, (0, None))
            if revision and expected is not None and expected != revision:
                return seq, "conflict"
            if not revision or old != state:
                nodes[i] = (revision + 1, state)
        elif kind == "create_edge":
            if t in most and sum(e[1:3] == (t, a) for e in edges) >= most[t]:
                return seq, "cardinality"
            edges.append((i, t, a, b))
        else:
            hit = next((e for e in edges if e[1:] == (t, a, b)), None)
            if hit is None:
                return seq, "not found"
            edges.remove(hit)
    return nodes, sorted(edges)


@pytest.mark.parametrize("seed", range(6))
def test_batches_against_plain_python(spark, seed):
    rng = random.Random(seed)
    nodes = {f"n{i}": (rng.randrange(1, 4), rng.choice("xyz")) for i in range(4)}
    edges = [(f"e{i}", rng.choice(["belongsTo", "emits"]), f"n{i}", rng.choice("pq")) for i in range(4)]
    ops = []
    for seq in range(14 if seed else 0):
        kind = rng.choice(["upsert", "create_edge", "remove_edge"] if seed % 2 else ["upsert", "upsert", "create_edge"])
        if kind == "upsert":
            ops.append((seq, kind, f"n{rng.randrange(6)}", rng.choice("xyz"), None, None, None, None))
        else:
            ops.append((seq, kind, f"x{seq}", None, None, rng.choice(["belongsTo"] * (seed % 2) + ["emits"] * 3), f"n{rng.randrange(3)}", rng.choice("pq")))
    want = applied(nodes, edges, ops, {"belongsTo": 1})
    held = spark.createDataFrame([(e[0], *e[1:], n) for n, e in enumerate(edges)], "id string, type string, source_id string, target_id string, ord long")
    out = store.commit(spark.createDataFrame([(k, *v) for k, v in nodes.items()], "id string, revision long, state string"), held, spark.createDataFrame(ops, OPS))
    if isinstance(want[0], int):
        first = min((r["seq"], r["error"]) for r in out["errors"].collect())
        assert first == want and out["events"].isEmpty() and out["edges"].count() == len(edges)
    else:
        assert out["errors"].isEmpty()
        assert {r["id"]: (r["revision"], r["state"]) for r in out["nodes"].collect()} == want[0]
        assert sorted((r["id"], r["type"], r["source_id"], r["target_id"]) for r in out["edges"].collect()) == want[1]


def test_expected_revisions(spark):
    nodes = spark.createDataFrame([("a", 3, "x")], "id string, revision long, state string")
    none = spark.createDataFrame([], "id string, type string, source_id string, target_id string, ord long")
    op = lambda seq, i, state, expected: (seq, "upsert", i, state, expected, None, None, None)
    good = store.commit(nodes, none, spark.createDataFrame([op(1, "a", "y", 3), op(2, "a", "z", 4), op(3, "new", "n", 9)], OPS))
    assert {tuple(r) for r in good["nodes"].collect()} == {("a", 5, "z"), ("new", 1, "n")}
    named = store.commit(nodes.withColumn("type", F.lit("T")), none, spark.createDataFrame([op(1, "a", "y", 3), op(2, "new", "n", 9)], OPS))["nodes"]
    assert {r["id"]: r["type"] for r in named.collect()} == {r["id"]: "T" for r in nodes.collect()} | {"new": None}
    bad = store.commit(nodes, none, spark.createDataFrame([op(1, "a", "y", 3), op(2, "a", "z", 3)], OPS))
    assert [tuple(r) for r in bad["errors"].collect()] == [(2, "a", "conflict")] and bad["nodes"].count() == 1


def entries(tmp_path, rows):
    (tmp_path / "e.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    return str(tmp_path / "e.jsonl")


def entity(i, kind, confidence=0.9, **data):
    return {"id": i, "type": kind, "version": "1", "confidence": confidence, "extractedAt": "2024-01-01", "source": {"file": "f"}, "data": data}


def relation(i, kind, a, b, confidence=0.9, **data):
    return entity(i, "Relationship", confidence, relationshipType=kind, sourceEntityId=a, targetEntityId=b, **data)


def test_mapping_and_edge_gate(spark, tmp_path):
    path = entries(tmp_path, [
        entity("d", "Decision", name="D", id="other"), entity("r", "Rule", name="R", validTo="2025"), entity("e", "Event", 0.1, name="E"), entity("s", "OrchestrationStep", name="S", evidencedBy=[{"source": "z"}]),
        relation("1", "evaluates", "d", "r"), relation("2", "consumes", "d", "e"), relation("3", "invokes", "s", "d"), relation("4", "evaluates", "d", "s"), relation("5", "dependsOn", "d", "gone"), relation("6", "dependsOn", "d", "r", 0.2), relation("7", "fulfils", "d", "r"), relation("8", "", "d", "r", metadata={"k": 1}),
    ])
    rows = files.read_run(spark, [None, path])
    nodes = {r["id"]: r for r in mapping.entry_nodes(rows).collect()}
    assert set(nodes) == {"d", "r", "e", "s"} and nodes["r"]["valid_to"] == "2025" and nodes["d"]["valid_from"] == "2024-01-01"
    assert nodes["d"]["evidence"][0]["source"] == "f" and nodes["s"]["evidence"][0]["source"] == "z"
    edges = mapping.entry_edges(rows)
    assert {r["id"]: r["problem"] for r in edges.where("problem is not null").collect()} == {"8": "missing relationshipType"}
    judged = gates.edge_emit_gate(edges.where("problem is null"), gates.emit_gate(mapping.entry_nodes(rows)))
    assert {r["id"]: (r["gate"], r["status"], r["reason"]) for r in judged.collect()} == {
        "1": ("decision", "emitted", None), "2": ("behavioural", "quarantined", "ends"), "3": ("behavioural", "emitted", None), "4": ("decision", "quarantined", "types"),
        "5": ("generic", "excluded", "ends"), "6": ("generic", "excluded", "confidence"), "7": ("functional", "quarantined", "types"),
    }
    raw = spark.createDataFrame([({"name": "N", "type": "T", "confidence": "1", "x": None},)], "row map<string,string>")
    assert raw.select(mapping.entity_data(F.col("row"))).first()[0] == {"name": "N"}


def test_command_line(spark, tmp_path, capsys):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# One\ntext\n## Two\nmore")
    (folder / "b.txt").write_text("plain")
    cli.main(["process", str(folder), "--out", str(tmp_path / "p")])
    chunks = spark.read.json(str(tmp_path / "p" / "chunks")).collect()
    assert {(r["location"], r["content"]) for r in chunks} >= {("Section: One", "# One\ntext"), ("Section: Two", "## Two\nmore")} and len(chunks) == 3
    path = entries(tmp_path, [entity("b", "BusinessCapability", name="Pay"), entity("a", "BusinessCapability", name="pay!"), entity("c", "BusinessCapability", name="Risk"), entity("low", "Rule", 0.1, name="x"), relation("1", "dependsOn", "b", "c"), relation("2", "dependsOn", "a", "c"), relation("3", "", "a", "c")])
    cli.main(["extract", path, "--out", str(tmp_path / "x")])
    cli.main(["normalise", str(tmp_path / "x"), "--out", str(tmp_path / "n")])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "n" / "nodes")).collect()) == ["a", "c"]
    assert [(r["source_id"], r["target_id"]) for r in spark.read.parquet(str(tmp_path / "n" / "edges")).collect()] == [("a", "c")]
    (tmp_path / "v.jsonl").write_text(json.dumps({"batch": 0, "name": "Risk", "disposition": "placed", "rationale": "r", "level": 9, "assigned_parent": "P"}))
    cli.main(["classify-architecture", str(tmp_path / "n"), str(tmp_path / "v.jsonl"), "--out", str(tmp_path / "k")])
    done = spark.read.json(str(tmp_path / "k" / "classifications")).collect()
    assert [(r["id"], r["subject"], r["confidence"]) for r in done] == [("cls-c", "c", 0.5)]
    assert "pending: 1 rows" in capsys.readouterr().out


def test_requests(spark, tmp_path):
    nodes = spark.createDataFrame([(i, "T", n) for i, n in (("a", "Card bank"), ("b", "Loan"), ("c", "Card"))], "id string, type string, name string")
    edges = spark.createDataFrame([("1", "t", "a", "b"), ("2", "t", "b", "c")], "id string, type string, source_id string, target_id string")
    engine, now = views.Engine(), [0.0]
    engine.register("count", lambda df: df)
    audit = api.Audit(spark, str(tmp_path / "audit"))
    one = api.Api(Service(nodes, edges), engine, {"count": (nodes,)}, api.Limits(cost=1000, requests=6, seconds=10, clock=lambda: now[0]), api.Cache(2), audit)
    ask = lambda field, **args: one.execute({"field": field, "args": args}, "u")
    assert one.fields() == ["ask", "count", "difference", "entries", "entry", "impact", "paths", "search", "state", "traverse"]
    assert ask("entry", id="a")["data"]["entry"]["name"] == "Card bank" and ask("entry", id="zz")["data"]["not_found"]
    assert not ask("traverse", start="a", depth=2)["cache_hit"] and ask("traverse", start="a", depth=2)["cache_hit"]
    with pytest.raises(api.Rejected, match="cost"):
        ask("traverse", start="a", depth=4)
    for field, args in (("traverse", {"start": "a"}), ("paths", {"source": "a", "target": "b"}), ("paths", {"source": "a", "target": "b", "depth": None})):
        with pytest.raises(api.Rejected, match="cost of 100000"):
            ask(field, **args)
    told = ask("ask", question="How are card and bank connected?")["data"]
    assert told["intent"] == "pathFinding" and [r["id"] for r in told["evidence"].collect()] == ["a", "c", "b"]
    assert ask("count")["data"]["entries_included"] == 3
    with pytest.raises(api.Rejected, match="more than"):
        ask("count")
    now[0] = 20.0
    with pytest.raises(api.Rejected, match="no such field"):
        ask("nothing")
    assert one.execute({"field": "search", "args": {"text": "loan"}, "select": ["id"]}, "u")["data"].columns == ["id"]
    outcomes = [r["outcome"] for r in audit.read().collect()]
    assert outcomes.count("refused") == 6 and outcomes.count("answered") == 7


def test_walks_with_large_frontiers(spark, monkeypatch):
    rng = random.Random(5)
    names = [f"v{i}" for i in range(12)]
    rows = [(f"e{i}", rng.choice("st"), rng.choice(names), rng.choice(names)) for i in range(40)]
    edges = spark.createDataFrame(rows, "id string, type string, source_id string, target_id string")
    nodes = spark.createDataFrame([(n, "T") for n in names[1:]], "id string, type string")

    def paths(at, seen, used, depth):
        if at == "v7" and used:
            return [(tuple(seen), tuple(used))]
        out = []
        for i, t, a, b in rows if len(used) < depth else []:
            if a == at and b not in seen and t == "s":
                out += paths(b, [*seen, b], [*used, i], depth)
        return out

    for small in (2000, 1, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        found = {(tuple(r["nodes"]), tuple(r["edge_ids"])) for r in graph.simple_paths(edges, "v0", "v7", 6, kinds=["s"]).collect()}
        assert found == set(paths("v0", ["v0"], [], 6))
        reached = {r["id"]: r["depth"] for r in graph.traverse(nodes, edges, spark.createDataFrame([("v0",)], "id string"), depth=8)[0].collect()}
        want, layer, d = {"v0": 0}, {"v0"}, 0
        while layer and d < 8:
            d += 1
            layer = {b for _, _, a, b in rows if a in layer} - want.keys()
            want |= dict.fromkeys(layer, d)
        assert reached == {k: v for k, v in want.items() if k != "v0"}


def test_merged_subgraphs(spark):
    kinds = "id string, type string, source_id string, target_id string"
    a = (spark.createDataFrame([("x", "first")], "id string, name string"), spark.createDataFrame([(None, "t", "x", "y"), ("1", "t", "x", "z")], kinds), False)
    b = (spark.createDataFrame([("x", "second"), ("y", "y")], "id string, name string"), spark.createDataFrame([(None, "t", "x", "y"), (None, "u", "x", "y"), ("1", "t", "x", "z")], kinds), True)
    nodes, edges, truncated = graph.merged_subgraphs(a, b)
    assert {tuple(r) for r in nodes.collect()} == {("x", "first"), ("y", "y")} and edges.count() == 3 and truncated


def test_prompts_and_gateway(spark):
    chunks = spark.createDataFrame([("d::chunk-0", "d", "S", "Section: S", "text")], "id string, document string, section_title string, location string, content string")
    prompt = extraction.entity_prompts(chunks, "SYSTEM", ["guide", "guide", "more"]).first()["prompt"]
    assert prompt.count("guide") == 1 and prompt.startswith("SYSTEM") and "[[doc:d]] [[section:S]]\nLocation: Section: S" in prompt and prompt.endswith("## Text\ntext")
    found = spark.createDataFrame([("d::chunk-0", "2", "T", "B"), ("d::chunk-0", "1", "T", "A")], "chunk string, id string, type string, name string")
    assert "- id=1 type=T name=A\n- id=2 type=T name=B" in extraction.relationship_prompts(chunks, found, "S").first()["prompt"]
    assert "none found" in extraction.relationship_prompts(chunks, found.limit(0), "S").first()["prompt"]
    batches = spark.createDataFrame([(0, "b"), (0, "a"), (0, "b")], "batch int, name string")
    assert extraction.name_prompts(batches, "Group these.").first()["prompt"] == "Group these.\n\nNames:\n- a\n- b"
    gateway = extraction.FakeGateway(lambda p: p[:3], 3)
    calls = gateway.extract(spark.createDataFrame([("abcdefgh",), (None,)], "prompt string"))
    assert [r["answer"] for r in calls.collect()] == ["abc", None] and tuple(extraction.token_usage(calls).first())[0] == 2
    assert gateway.embed(spark.createDataFrame([("ab",)], "text string")).first()["embedding"] == [98 * 0 + (195 * i % 97) / 97 for i in (1, 2, 3)]
    rows = spark.createDataFrame([("m", "VendorCapabilityMapping", "Fully supported"), ("o", "Other", "Fully supported")], "id string, type string, coverage string")
    assert [r["coverage"] for r in extraction.standard_normalisers().apply(rows).orderBy("id").collect()] == ["full", "Fully supported"]
    lines = [r["line"] for r in extraction.prompt_dump(rows, rows.limit(0), "Why?").collect()]
    assert lines[0] == "QUESTION: Why?" and json.loads(lines[2])["id"] == "m" and lines[-1] == "=== RELATIONSHIPS ==="


def test_names_values_and_facets(spark):
    rows = spark.createDataFrame([("1", " ", None, "x > 1", "cap"), ("2", None, None, None, "cap"), ("3", None, None, None, None)], "id string, name string, statement string, expression string, vendor_capability string")
    assert [tuple(r) for r in rows.orderBy("id").select(tx.entity_name(), tx.entity_name(mapping=True)).collect()] == [("x > 1", "x > 1"), ("2", "cap"), ("3", "3")]
    assert spark.range(1).select(tx.json_literal(F.lit("{bad")).isNull(), q.field_completeness()).first() == (True, 0.5)
    assert lookup.pushed_filters(["active"], ["o", "p"]) == [("lifecycle_status", "eq", "active")]
    assert lookup.cross_type_total([1, None, 2]) == 3 and lookup.cross_type_total([None]) is None
    states = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, lifecycle_status string")
    assert lookup.faceted(states, lifecycles=["a"], pushed=True).count() == 2 and lookup.faceted(states, lifecycles=["a"]).count() == 1
    with pytest.raises(ValueError, match="no such way"):
        search.merged([], "other", 1)


def test_relations_outlines_and_documents(spark):
    entities = spark.createDataFrame([("1", "A b"), ("2", "C")], "id string, name string")
    relations = spark.createDataFrame([("t", "1", "2"), ("t", "1", "9"), (None, "1", "2")], "type string, source_id string, target_id string")
    assert [tuple(r) for r in evaluation.named_relations(relations, entities).collect()] == [("t", "a b", "c")]
    spine = spark.createDataFrame([("B", 1, None), ("A", 1, None), ("y", 2, "B"), ("x", 2, "B"), ("z", 2, "none")], "name string, level int, parent string")
    assert [tuple(r) for r in resolution.spine_outline(spine).collect()] == [("A", []), ("B", ["x", "y"])]


def test_companions(spark, tmp_path):
    docs = spark.createDataFrame([("x/a.txt", "one"), ("y/a.md", "two"), ("b.md", None)], "path string, content string")
    out = {r["path"]: r["file"] for r in files.write_companions(docs, str(tmp_path / "md")).collect()}
    assert out == {"x/a.txt": "a.md", "y/a.md": "a-2.md", "b.md": "b.md"}
    assert (tmp_path / "md" / "a-2.md").read_text() == "two" and (tmp_path / "md" / "b.md").read_text() == ""


def test_whole_views_and_renders(spark, monkeypatch):
    kinds = "id string, type string, name string, domain string, vendor string, claims array<string>, subdomain string"
    nodes = spark.createDataFrame([("cap", "BusinessCapability", 'C"1', "Pay", None, None, None), ("con", "DomainConcept", "K", "Pay", None, None, None), ("p1", "VendorProduct", "P", None, "Acme", ["c1"], None), ("sd", "Subdomain", "Sub", None, None, None, None), ("bc", "BoundedContext", "Ctx", None, None, None, None), ("d", "Decision", "Dec", None, None, None, None)], kinds)
    edges = spark.createDataFrame([("1", "belongsTo", "bc", "sd"), ("2", "belongsTo", "con", "bc"), ("3", "belongsTo", "d", "bc"), ("4", "governs", "d", "con"), ("5", "fulfils", "p1", "cap")], "id string, type string, source_id string, target_id string")
    maps = spark.createDataFrame([], "id string, capability string, target_id string, coverage string, percentage double, gaps array<string>")
    cover = views.coverage_view(nodes, edges, maps, vendor="acme", domain="PAY")
    assert [(r["row"], r["column"], r["status"]) for r in cover["cells"].collect()] == [("cap", "p1", "uncovered")]
    assert views.coverage_view(nodes, edges, maps, vendor="none")["cells"].isEmpty()
    with monkeypatch.context() as m, pytest.raises(ValueError, match="name a vendor"):
        m.setattr(views, "MOST_COLUMNS", 0)
        views.coverage_view(nodes, edges, maps)
    gaps = views.gap_view(nodes, edges, maps)
    assert [(r["id"], r["kind"], r["priority"]) for r in gaps["gaps"].collect()] == [("cap", "BusinessCapability", 1), ("con", "DomainConcept", 1)]
    text = views.gaps_markdown(gaps)
    assert "1 functional gap · 2 technical gaps · 0 fully realised (of 2 assessed)" in text and "| 1 | K | DomainConcept | L2 + L3 |" in text
    assert text.split("\n")[4:6] == views.GAP_HEAD
    assert views.gaps_markdown(views.gap_view(nodes, edges, maps, domain="none")).split("\n")[4:] == [views.GAP_NONE]
    assert "No gaps" in views.gaps_markdown(views.gap_view(nodes, edges, maps, domain="none"))
    lines = [r["line"] for r in views.domain_diagram(nodes, edges).collect()]
    assert lines == ['package "Sub" as sd {', '  package "Ctx\\n1 concepts · 0 services" as bc {', '    rectangle "Dec" as d <<Decision>>', '    rectangle "K" as con <<DomainConcept>>', "  }", "}", "d --> con : governs"]
    steps = spark.createDataFrame([("d", "con"), ("con", None)], "step string, next string")
    drawn = [r["line"] for r in views.behaviour_diagram(nodes.where("id in ('d', 'con')"), edges, steps).collect()]
    assert drawn == ['rectangle "K" as con <<DomainConcept>>', 'hexagon "Dec" as d <<Decision>>', "d -[dashed]-> con : then", "d -[bold]-> con : governs"]
    engine = views.standard_engine()
    assert engine.get("gap-analysis", nodes, edges, maps)["entries_included"] == 2 and engine.get("vendor-coverage", nodes, edges, maps)["entries_included"] == 1
