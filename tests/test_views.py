"""Seeded graphs of each view, and that the matrix and the gap list agree."""

import pytest
from pyspark.sql import functions as F

from skein.operators import realisation
from skein.plans import views


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def edges_of(spark, rows):
    return frame(spark, [(f"e{i}", *r) for i, r in enumerate(rows)], "id type source_id target_id")


@pytest.fixture(scope="module")
def coverage(spark):
    rows = frame(spark, [(f"cap-{n}", n.title()) for n in ("auth", "settle", "report", "fraud", "clear")], "id name")
    edges = edges_of(spark, [("fulfils", "p1", "cap-auth"), ("implements", "s1", "cap-auth"), ("fulfils", "p2", "cap-settle"), ("implements", "s2", "cap-clear"), ("fulfils", "p1", "cap-clear"), ("dependsOn", "x", "cap-fraud"), ("dependsOn", "y", "cap-fraud")])
    maps = spark.createDataFrame(
        [("m1", "c1", "cap-auth", "full", 100.0, []), ("m2", "c1", "cap-settle", "partial", 40.0, ["late"]), ("m3", "c2", "cap-settle", "partial", None, ["small"]), ("m4", "c2", "cap-clear", "full", 90.0, []), ("m5", "c3", "cap-report", "partial", 10.0, []), ("m6", "c3", "cap-fraud", "none", 0.0, ["all"])],
        "id string, capability string, target_id string, coverage string, percentage double, gaps array<string>",
    )
    claims = frame(spark, [("p1", "c1"), ("p2", "c2"), ("p2", "c1"), ("p2", "c1")], "column capability")
    return rows, edges, maps, claims


def test_coverage_and_gaps_agree(coverage):
    rows, edges, maps, claims = coverage
    cover = views.vendor_coverage(rows, edges, maps, claims)
    status = {r["id"]: r["status"] for r in cover["rows"].collect()}
    assert status == {"cap-auth": "covered", "cap-settle": "partial", "cap-report": "partial", "cap-fraud": "uncovered", "cap-clear": "covered"}
    assert tuple(cover["summary"].first()) == (2, 2, 1, 5, 60)
    gaps = views.gap_analysis(rows, edges, maps)
    assert [(r["id"], r["missing"], r["priority"]) for r in gaps["gaps"].collect()] == [("cap-fraud", ["L2", "L3"], 2), ("cap-settle", ["L3"], 1), ("cap-report", ["L3"], 0)]
    assert tuple(gaps["summary"].first()) == (5, 1, 3, 2)
    only = views.gap_analysis(rows, edges, maps, "functional")
    assert [r["id"] for r in only["gaps"].collect()] == ["cap-fraud"] and tuple(only["summary"].first()) == (5, 1, 3, 2)
    assert {k for k, v in status.items() if v == "uncovered"} == {r["id"] for r in only["gaps"].collect()}


def test_cells_are_worst_wins(coverage):
    cells = {(r["row"], r["column"]): (r["status"], r["percentage"], r["first_mapping"], r["gaps"]) for r in views.vendor_coverage(*coverage)["cells"].collect()}
    assert cells[("cap-settle", "p2")] == ("partial", 40.0, "m2", ["late", "small"])
    assert cells[("cap-auth", "p1")] == ("covered", 100.0, "m1", []) and ("cap-report", "p1") not in cells
    assert "| cap-auth | covered | covered |" in views.matrix_markdown(views.vendor_coverage(*coverage)["cells"], ["p1", "p2"])


def test_empty_matrix(spark, coverage):
    empty = coverage[0].limit(0)
    assert realisation.coverage_summary(empty.withColumn("status", F.lit("x"))).first()["percentage"] == 0


def test_matrix_of_a_vendor_with_many_products(spark, monkeypatch):
    monkeypatch.setattr(views, "MOST_COLUMNS", 2)
    kinds = "id string, type string, name string, domain string, vendor string, claims array<string>"
    nodes = spark.createDataFrame([("cap", "BusinessCapability", "C", None, None, None)] + [(f"p{i}", "VendorProduct", "P", None, "Acme", ["c1"] if i == 3 else None) for i in range(5)], kinds)
    maps = spark.createDataFrame([("m", "c1", "cap", "full", 9.0, ["g"])], "id string, capability string, target_id string, coverage string, percentage double, gaps array<string>")
    cells = views.coverage_view(nodes, edges_of(spark, [("fulfils", "p1", "cap")]), maps, vendor="acme")["cells"]
    assert {(r["row"], r["column"], r["status"]) for r in cells.collect()} == {("cap", f"p{i}", "covered" if i == 3 else "uncovered") for i in range(5)}


def test_domain_map(spark):
    nodes = frame(spark, [("sd1", "Subdomain", "Pay", None), ("sd2", "Subdomain", "Risk", None), ("bc-auth", "BoundedContext", "Auth", None), ("bc-settle", "BoundedContext", "Settle", "sd2"), ("bc-lone", "BoundedContext", "Lone", None)] + [(c, "DomainConcept", c, None) for c in ("c1", "c2", "c3")] + [("s1", "Service", "s1", None)], "id type name subdomain")
    edges = edges_of(spark, [("belongsTo", "bc-auth", "sd1"), ("belongsTo", "c1", "bc-auth"), ("belongsTo", "c2", "bc-auth"), ("belongsTo", "s1", "bc-auth"), ("belongsTo", "c3", "bc-settle"), ("settledBy", "c1", "c3"), ("scoredBy", "c1", "c3"), ("scoredBy", "c2", "c3"), ("scoredBy", "c1", "c2")])
    out = {r["id"]: (r["subdomain"], r["concepts"], r["services"]) for r in views.context_counts(nodes, edges).collect()}
    assert out == {"bc-auth": ("sd1", 2, 1), "bc-settle": ("sd2", 1, 0), "bc-lone": (views.UNASSIGNED, 0, 0)}
    assert {tuple(r) for r in views.cross_context(nodes, edges).collect()} == {("bc-auth", "bc-settle", "settledBy", 1), ("bc-auth", "bc-settle", "scoredBy", 2)}
    assert [r["id"] for r in views.domain_map(nodes, edges, "PAY").collect()] == ["bc-auth"]
    assert views.domain_map(nodes.limit(0), edges).count() == 0


def test_capability_map(spark):
    rows = [("c1", "Payments", None, None), ("c2", "Cards", " payments ", ["plastic"]), ("c3", "Issuing", "PLASTIC", None), ("c4", "Lost", "Nowhere", None), ("c5", "A", "B", None), ("c6", "B", "A", None)]
    nodes = spark.createDataFrame([(i, "BusinessCapability", n, p, a) for i, n, p, a in rows] + [("s", "Service", "S", None, None)], "id string, type string, name string, parent_name string, aliases array<string>")
    edges = edges_of(spark, [("implements", "s", "c2"), ("implements", "s", "c2")])
    out = {r["id"]: r for r in views.capability_map(nodes, edges).collect()}
    assert len(out) == 6 and out["c3"]["path"] == ["Payments", "Cards", "Issuing"] and out["c1"]["descendants"] == 2
    assert out["c4"]["orphaned"] and not out["c6"]["orphaned"] and out["c6"]["parent"] is None and out["c5"]["parent"] == "c6"
    assert out["c2"]["neighbours"] == 1
    assert {r["id"] for r in views.capability_map(nodes, edges, "cards").collect()} == {"c2", "c3"}


def test_business_architecture(spark):
    nodes = frame(spark, [("r1", "ReferenceCapability", "Core", None), ("r2", "ReferenceCapability", "Lending", "core"), ("k1", "BusinessCapability", "Loans", None), ("k2", "BusinessCapability", "Mortgages", None), ("k3", "BusinessCapability", "Noise", None), ("k4", "BusinessCapability", "Homeless", None), ("k5", "BusinessCapability", "Unseen", None)], "id type name parent_name")
    verdicts = spark.createDataFrame([("v1", "k1", "placed", "Lending", None, 0.9), ("v2", "k2", "placed", "loans", None, 0.9), ("v3", "k3", "rejected", None, "too vague", 0.9), ("v4", "k4", "placed", "nowhere", None, 0.9), ("v5", "k1", "placed", "Core", None, 0.2)], "id string, subject string, disposition string, assigned_parent string, rejection_reason string, confidence double")
    out = views.business_architecture(nodes, verdicts, least=0.5)
    assert {r["id"]: r["path"] for r in out["tree"].collect()} == {"r1": ["Core"], "r2": ["Core", "Lending"], "k1": ["Core", "Lending", "Loans"], "k2": ["Core", "Lending", "Loans", "Mortgages"]}
    assert [tuple(r) for r in out["rejected"].collect()] == [("too vague", 1)]
    assert [r["id"] for r in out["unclassified"].collect()] == ["k4", "k5"]
    assert {r["id"]: r["parent"] for r in views.business_architecture(nodes, verdicts)["tree"].collect()}["k1"] == "r1"


def test_behaviour_flow(spark):
    nodes = spark.createDataFrame(
        [("f", "OrchestrationFlow", "Flow", ["s2", "s1", "s3", "ev"], None, None, None)] + [(f"s{i}", "OrchestrationStep", f"s{i}", None, i, None, None) for i in (1, 2, 3)] + [("ev", "Event", "Started", None, None, None, None), ("ok", "Event", " Approved", None, None, None, None), ("tr", "StateTransition", "t", None, None, None, None), ("d", "Decision", "Decide", None, None, ["approved", "declined"], "oracle")],
        "id string, type string, name string, steps array<string>, sequence int, outcomes array<string>, decision_type string",
    )
    edges = edges_of(spark, [("triggers", "ev", "f"), ("emits", "s1", "ok"), ("transitionsTo", "s2", "tr"), ("invokes", "s3", "d"), ("produces", "d", "ok"), ("compensates", "s3", "s1"), ("emits", "s2", "tr")])
    out = views.behaviour_flow(nodes, edges, "f").collect()
    assert [(r["step"], r["position"], r["next"]) for r in out] == [("s1", 0, "s2"), ("s2", 1, "s3"), ("s3", 2, None)]
    assert out[0]["consumes"] == ["ev"] and out[1]["consumes"] == [] and out[0]["emits"] == ["ok"] and out[1]["transitions"] == ["tr"] and out[1]["emits"] == []
    assert out[2]["compensates"] == "s1" and out[2]["decision_type"] == "automated" and [tuple(o) for o in out[2]["outcomes"]] == [("approved", "ok"), ("declined", None)]
    assert views.behaviour_flow(nodes, edges, "none").count() == 0
    assert "s1 --> s2 : then" in [r["line"] for r in views.flow_diagram(views.behaviour_flow(nodes, edges, "f").select("flow", "step", "position", "next")).collect()]


def test_engine(spark):
    engine = views.standard_engine()
    engine.register("one", lambda df: df)
    engine.register("one", lambda df: df.limit(1))
    assert engine.list() == ["behaviour-flow", "business-architecture", "capability-map", "domain-map", "gap-analysis", "one", "vendor-coverage"]
    got = engine.get("one", spark.range(5))
    assert got["entries_included"] == 1 and got["stale"] is False and got["cache_hit"] is False
    with pytest.raises(KeyError):
        engine.get("two", spark.range(1))
