"""Queries of the graph engine's operators over the star schema, by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents as docs_f
from .functions import quality as q
from .functions import text as tx
from .operators import display, evaluation, extraction, gates, graph, lookup, realisation, resolution, search, temporal
from .plans import views
from .sources import files, star
from .sources.star import EDGES_SQL, NODES_SQL, SHIPPED_SQL
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MOMENT, LATER = "2024-01-10 00:00:00", "2024-01-20 00:00:00"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL of its result where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return star.nodes(spark, sf), star.edges(spark, sf)


GRAPH = f"WITH {NODES_SQL}, {EDGES_SQL} "
COVER = f"WITH {SHIPPED_SQL} "

# --- lookups, listings, filters -------------------------------------------------------------------------


@query(f"WITH {NODES_SQL} SELECT * FROM nodes WHERE id = 'c7'")
def entity_lookup(spark, sf):
    return lookup.get_node(star.nodes(spark, sf), "c7")


@query(f"WITH {NODES_SQL} SELECT * FROM nodes WHERE type = 'DomainConcept' ORDER BY name DESC, id LIMIT 25")
def type_listing_page1(spark, sf):
    return lookup.list_page(star.nodes(spark, sf), "DomainConcept", sort="name", descending=True)


@query(f"WITH {NODES_SQL} SELECT * FROM nodes WHERE type = 'DomainConcept' AND (confidence > 0.5 OR (confidence = 0.5 AND id > 'c151')) ORDER BY confidence, id LIMIT 100")
def type_listing_after_cursor(spark, sf):
    cursor = lookup.encode_cursor(0.5, "c151")
    return lookup.list_page(star.nodes(spark, sf), "DomainConcept", sort="confidence", limit=250, cursor=cursor)


@query(f"WITH {NODES_SQL} SELECT id, segment FROM nodes WHERE type = 'DomainConcept' AND segment = 'BUILDING' AND lifecycle_status = 'active'")
def property_filter_eq(spark, sf):
    return lookup.find_by_type(star.nodes(spark, sf), "DomainConcept", [("segment", "eq", "BUILDING"), ("lifecycle_status", "eq", "active")]).select("id", "segment")


@query(f"WITH {NODES_SQL} SELECT id, type, segment FROM nodes WHERE segment IS DISTINCT FROM 'BUILDING'")
def property_filter_neq_null_safe(spark, sf):
    return star.nodes(spark, sf).where(lookup.matches("segment", "neq", "BUILDING")).select("id", "type", "segment")


@query(GRAPH + "SELECT * FROM edges WHERE source_id = 'n3'")
def edges_out(spark, sf):
    return lookup.edges_of(star.edges(spark, sf), "n3", "out")


@query(GRAPH + "SELECT * FROM edges WHERE target_id = 'n3' AND type = 'belongsTo'")
def edges_in(spark, sf):
    return lookup.edges_of(star.edges(spark, sf), "n3", "in", "belongsTo")


@query(GRAPH + "SELECT * FROM edges WHERE target_id = 'c11' OR source_id = 'c11'")
def edges_both(spark, sf):
    return lookup.edges_of(star.edges(spark, sf), "c11")


@query(f"WITH {NODES_SQL} SELECT 'type' AS facet, type AS value, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'lifecycle_status', lifecycle_status, count(*) FROM nodes GROUP BY lifecycle_status UNION ALL SELECT 'segment', segment, count(*) FROM nodes GROUP BY segment")
def facet_counts(spark, sf):
    return lookup.facet_counts(star.nodes(spark, sf), ["type", "lifecycle_status", "segment"])


@query(f"WITH {NODES_SQL} SELECT id, name FROM nodes WHERE type IN ('Service', 'BoundedContext') AND lifecycle_status IN ('active', 'retired') AND confidence BETWEEN 0.1 AND 0.8 AND (contains(lower(name), 'a') OR contains(lower(id), 'a'))")
def faceted_rows(spark, sf):
    return lookup.faceted(star.nodes(spark, sf), types=["Service", "BoundedContext"], lifecycles=["active", "retired"], band=(0.1, 0.8), text="A").select("id", "name")


@query(GRAPH + "SELECT e.type, e.direction, e.other_id, coalesce(n.name, e.other_id) AS label FROM (SELECT type, 'out' AS direction, target_id AS other_id FROM edges WHERE source_id = 'n3' UNION ALL SELECT type, 'in', source_id FROM edges WHERE target_id = 'n3' AND source_id <> 'n3') e LEFT JOIN nodes n ON n.id = e.other_id")
def entry_detail(spark, sf):
    return lookup.entry_detail(*_both(spark, sf), "n3")


@query(GRAPH + "SELECT id, name, confidence FROM nodes WHERE type = 'Service' ORDER BY confidence DESC NULLS LAST, id LIMIT 40")
def display_sorted(spark, sf):
    return star.nodes(spark, sf).where("type = 'Service'").orderBy(*lookup.display_order(True, "confidence")).limit(40).select("id", "name", "confidence")


# --- graph -----------------------------------------------------------------------------------------------------


@query(GRAPH + ", a AS (SELECT DISTINCT target_id AS id FROM edges WHERE source_id = 'c3'), b AS (SELECT DISTINCT target_id AS id FROM edges JOIN a ON source_id = a.id) SELECT id, min(depth) AS depth FROM (SELECT 'c3' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b) x GROUP BY id")
def traverse_depth2(spark, sf):
    nodes, edges = _both(spark, sf)
    return graph.traverse(nodes, edges, nodes.where("id = 'c3'"), depth=2)[0]


@query(GRAPH + ", w AS (SELECT source_id AS src, target_id AS next, id FROM edges WHERE type = 'belongsTo' UNION ALL SELECT target_id, source_id, id FROM edges WHERE type = 'belongsTo'), ok AS (SELECT w.* FROM w JOIN nodes n ON n.id = w.next AND n.type IN ('BoundedContext', 'Service')), a AS (SELECT DISTINCT next AS id FROM ok WHERE src = 'r1'), b AS (SELECT DISTINCT next AS id FROM ok JOIN a ON src = a.id), c AS (SELECT DISTINCT next AS id FROM ok JOIN b ON src = b.id) SELECT id, min(depth) AS depth FROM (SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b UNION ALL SELECT id, 3 FROM c) x GROUP BY id")
def traverse_both_typed(spark, sf):
    nodes, edges = _both(spark, sf)
    return graph.traverse(nodes, edges, nodes.where("id = 'r1'"), "both", ["belongsTo"], ["BoundedContext", "Service"], 3)[0]


@query(GRAPH + "SELECT DISTINCT e.id AS edge_id FROM edges e WHERE e.source_id = 'c3' OR e.source_id IN (SELECT target_id FROM edges WHERE source_id = 'c3')")
def traverse_edges_seen(spark, sf):
    nodes, edges = _both(spark, sf)
    return graph.traverse(nodes, edges, nodes.where("id = 'c3'"), depth=2)[1]


@query(
    GRAPH
    + "SELECT 'c3|' || a.target_id || '|' || b.target_id || '|' || c.target_id AS path, 3 AS length FROM edges a JOIN edges b ON b.source_id = a.target_id JOIN edges c ON c.source_id = b.target_id "
    + "WHERE a.source_id = 'c3' AND c.target_id = 'r2' AND a.target_id <> 'r2' AND b.target_id <> 'r2' "
    + "UNION ALL SELECT 'c3|' || a.target_id || '|' || b.target_id, 2 FROM edges a JOIN edges b ON b.source_id = a.target_id WHERE a.source_id = 'c3' AND b.target_id = 'r2' AND a.target_id <> 'r2'"
)
def simple_paths_depth3(spark, sf):
    return graph.simple_paths(star.edges(spark, sf), "c3", "r2", 3).select(F.array_join("nodes", "|").alias("path"), "length")


@query(GRAPH + "SELECT id, sum(o) AS out_degree, sum(i) AS in_degree, sum(o) + sum(i) AS degree FROM (SELECT source_id AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT target_id, 0, 1 FROM edges) x GROUP BY id")
def node_degrees(spark, sf):
    return graph.degrees(star.edges(spark, sf))


@query(GRAPH + "SELECT e.* FROM edges e JOIN nodes a ON a.id = e.source_id AND a.type IN ('DomainConcept', 'Service') JOIN nodes b ON b.id = e.target_id AND b.type IN ('DomainConcept', 'Service')")
def induced_subgraph(spark, sf):
    nodes, edges = _both(spark, sf)
    return graph.induced(nodes.where("type in ('DomainConcept', 'Service')"), edges)


@query(GRAPH + ", s AS (SELECT id, type, source_id, target_id FROM edges WHERE type = 'belongsTo'), u AS (SELECT source_id AS id, 'r' || min(CAST(substr(target_id, 2) AS INT)) AS component FROM s WHERE target_id LIKE 'r%' GROUP BY source_id) SELECT id, component FROM (SELECT n.id, coalesce(u.component, CASE WHEN n.id LIKE 'r%' THEN n.id END, v.component) AS region FROM nodes n LEFT JOIN u ON u.id = n.id LEFT JOIN s ON s.source_id = n.id AND s.target_id LIKE 'n%' LEFT JOIN u v ON v.id = s.target_id) x JOIN (SELECT region AS r, min(id) AS component FROM (SELECT n.id, coalesce(u.component, CASE WHEN n.id LIKE 'r%' THEN n.id END, v.component) AS region FROM nodes n LEFT JOIN u ON u.id = n.id LEFT JOIN s ON s.source_id = n.id AND s.target_id LIKE 'n%' LEFT JOIN u v ON v.id = s.target_id) y GROUP BY region) m ON m.r = x.region")
def connected_components(spark, sf):
    edges = star.edges(spark, sf).where("type = 'belongsTo'")
    return graph.components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))


_TREE = "tree AS (SELECT 't' || p_type AS id, CAST(NULL AS VARCHAR) AS parent FROM part GROUP BY p_type UNION ALL SELECT 'b' || p_brand, 't' || min(p_type) FROM part GROUP BY p_brand UNION ALL SELECT 'p' || p_partkey, 'b' || p_brand FROM part), closed AS (SELECT id AS ancestor, id, 0 AS distance FROM tree UNION ALL SELECT parent, id, 1 FROM tree WHERE parent IS NOT NULL UNION ALL SELECT b.parent, a.id, 2 FROM tree a JOIN tree b ON b.id = a.parent WHERE b.parent IS NOT NULL) "


def _tree(spark, sf):
    part = star.table(spark, sf, "part")
    top = part.select(F.concat(F.lit("t"), "p_type").alias("id"), F.lit(None).cast("string").alias("parent")).distinct()
    mid = part.groupBy("p_brand").agg(F.min("p_type").alias("t")).select(F.concat(F.lit("b"), "p_brand").alias("id"), F.concat(F.lit("t"), "t").alias("parent"))
    return top.unionByName(mid).unionByName(part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("b"), "p_brand").alias("parent")))


@query("WITH " + _TREE + "SELECT ancestor, id, distance FROM closed")
def capability_forest_closure(spark, sf):
    return graph.closure(graph.forest(_tree(spark, sf)))


@query("WITH " + _TREE + "SELECT ancestor AS id, count(*) - 1 AS descendants FROM closed GROUP BY ancestor")
def descendant_counts(spark, sf):
    return graph.descendant_counts(graph.forest(_tree(spark, sf)))


_IMPACT = GRAPH + ", w AS (SELECT e.source_id AS src, e.target_id AS next, n.confidence AS weight FROM edges e JOIN nodes n ON n.id = e.target_id), d1 AS (SELECT next AS id, max(weight) AS weight FROM w WHERE src = 'c3' GROUP BY next HAVING max(weight) * 0.9 / 1.3 >= 0.05), d2 AS (SELECT w.next AS id, max(d1.weight * w.weight) AS weight FROM d1 JOIN w ON w.src = d1.id GROUP BY w.next HAVING max(d1.weight * w.weight) * 0.9 / 1.6 >= 0.05), al AS (SELECT id, weight * 0.9 / 1.3 AS score FROM d1 UNION ALL SELECT id, weight * 0.9 / 1.6 FROM d2) SELECT id, round(max(score), 6) AS score FROM al WHERE id <> 'c3' GROUP BY id"


@query(_IMPACT)
def impact_scores(spark, sf):
    nodes, edges = _both(spark, sf)
    weighed = edges.join(nodes.select(F.col("id").alias("target_id"), "confidence"), "target_id").withColumn("strength", F.lit(1.0))
    return graph.impact(weighed, "c3", 0.9, 2, 0.05).select("id", F.round("score", 6).alias("score"))


# --- domain map --------------------------------------------------------------------------------------------------


@query("SELECT 'n' || n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS subdomain, coalesce(c.k, 0) AS concepts, coalesce(s.k, 0) AS services FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def domain_map_counts(spark, sf):
    return views.context_counts(*_both(spark, sf))


_CROSS = "SELECT 'n' || c_nationkey AS source, 'n' || s_nationkey AS target, 'consumes' AS type, count(*) AS strength FROM (SELECT DISTINCT o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey) x JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"


@query(_CROSS)
def cross_context_strength(spark, sf):
    return views.cross_context(*_both(spark, sf))


@query(f"SELECT 'n' || n_nationkey AS id, r_name AS subdomain_name, coalesce(k, 0) AS relationships FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN (SELECT source, count(*) AS k FROM ({_CROSS}) y GROUP BY source) z ON z.source = 'n' || n_nationkey WHERE lower(r_name) = 'asia'")
def domain_map_scoped(spark, sf):
    return views.domain_map(*_both(spark, sf), subdomain="Asia").select("id", "subdomain_name", F.when(F.col("relationships").isNull(), 0).otherwise(F.size("relationships")).cast("long").alias("relationships"))


@query("WITH b AS (SELECT 'n' || n_nationkey AS id, 'BoundedContext' AS kind, 'r' || n_regionkey AS ctx FROM nation UNION ALL SELECT 'r' || n_regionkey, 'Subdomain', 'n' || n_nationkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'DomainConcept', 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'Service', 'n' || s_nationkey FROM supplier) SELECT ctx AS id, kind, count(DISTINCT id) AS n FROM b WHERE ctx LIKE 'n%' GROUP BY ctx, kind")
def evidence_counts(spark, sf):
    nodes, edges = _both(spark, sf)
    return views.evidence_counts(nodes.where("type = 'BoundedContext'"), nodes, edges)


@query("WITH " + _TREE + "SELECT id, max(distance) AS depth FROM closed GROUP BY id")
def capability_depths(spark, sf):
    tree = graph.forest(_tree(spark, sf)).withColumn("name", F.col("id"))
    return graph.with_paths(tree).select("id", "depth")


# --- coverage and gaps -----------------------------------------------------------------------------------------------

_REALISED = COVER + """, e AS (SELECT target_id, count_if(type = 'fulfils') AS fulfils, count_if(type = 'implements') AS technical, count(*) AS incoming FROM brand_edges GROUP BY target_id),
m AS (SELECT target_id, bool_or(coverage = 'full') AS any_full, bool_or(coverage <> 'none') AS any_mapped FROM mappings GROUP BY target_id),
assessed AS (SELECT b.id, b.name, coalesce(incoming, 0) AS incoming, coalesce(fulfils, 0) > 0 OR coalesce(any_mapped, FALSE) AS functional, coalesce(technical, 0) > 0 AS technical, coalesce(any_full, FALSE) AS any_full
  FROM brands b LEFT JOIN e ON e.target_id = b.id LEFT JOIN m ON m.target_id = b.id) """
_ASSESSED = _REALISED.replace("FROM brand_edges", "FROM thin_edges")


def _assessed(spark, sf, thin=True):
    """Brands with what realises them; the thin edges leave gaps, the whole ones none."""
    return realisation.elements(star.brands(spark, sf), star.brand_edges(spark, sf, thin), star.mappings(spark, sf))


@query(COVER + "SELECT b.id, coalesce(count_if(type = 'fulfils'), 0) AS fulfils, coalesce(count_if(type = 'implements'), 0) AS implements, count(e.id) AS incoming FROM brands b LEFT JOIN brand_edges e ON e.target_id = b.id GROUP BY b.id")
def realisation_counts(spark, sf):
    """How many edges of each kind realise a brand."""
    counted = star.brand_edges(spark, sf).groupBy(F.col("target_id").alias("id")).agg(F.count_if(F.col("type") == "fulfils").alias("fulfils"), F.count_if(F.col("type") == "implements").alias("implements"), F.count("id").alias("incoming"))
    return star.brands(spark, sf).join(counted, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("fulfils", "implements", "incoming")))


@query(_REALISED + "SELECT id, CASE WHEN NOT functional THEN 'uncovered' WHEN any_full THEN 'covered' ELSE 'partial' END AS status FROM assessed")
def coverage_rows(spark, sf):
    return _assessed(spark, sf, thin=False).select("id", realisation.row_status().alias("status"))


@query(COVER + ", claims AS (SELECT DISTINCT 's' || supplier AS \"column\", 'cap-' || nation AS capability FROM shipped) SELECT target_id AS \"row\", \"column\", CASE WHEN bool_or(coverage = 'none') THEN 'uncovered' WHEN bool_or(coverage = 'partial') THEN 'partial' ELSE 'covered' END AS status, max(percentage) AS percentage, min(id) AS first_mapping FROM mappings JOIN claims USING (capability) GROUP BY target_id, \"column\"")
def coverage_matrix(spark, sf):
    claims = star.shipped(spark, sf).select(F.concat(F.lit("s"), F.col("supplier").cast("string")).alias("column"), F.concat(F.lit("cap-"), F.col("nation").cast("string")).alias("capability"))
    return realisation.cells(star.mappings(spark, sf), claims).drop("gaps")


@query(_REALISED + "SELECT count_if(functional AND any_full) AS covered, count_if(functional AND NOT any_full) AS partial, count_if(NOT functional) AS uncovered, count(*) AS total, CAST(floor((count_if(functional AND any_full) + 0.5 * count_if(functional AND NOT any_full)) / count(*) * 100 + 0.5) AS BIGINT) AS percentage FROM assessed")
def coverage_summary(spark, sf):
    return realisation.coverage_summary(_assessed(spark, sf, thin=False).withColumn("status", realisation.row_status()))


@query(_ASSESSED + "SELECT id, name, CASE WHEN NOT functional AND NOT technical THEN 'L2,L3' WHEN NOT functional THEN 'L2' ELSE 'L3' END AS missing, incoming AS priority, CASE WHEN NOT functional AND NOT technical THEN 'neither a functional nor a technical realisation' WHEN NOT functional THEN 'technically realised, but not functionally' ELSE 'functionally realised, but not technically' END AS reason FROM assessed WHERE NOT functional OR NOT technical")
def gap_list(spark, sf):
    return realisation.gaps(_assessed(spark, sf)).withColumn("missing", F.array_join("missing", ","))


@query(_ASSESSED + "SELECT count(*) AS total, count_if(NOT functional) AS functional_gaps, count_if(NOT technical) AS technical_gaps, count_if(functional AND technical) AS fully_realised FROM assessed")
def gap_summary(spark, sf):
    return realisation.gap_summary(_assessed(spark, sf))


# --- behaviour ----------------------------------------------------------------------------------------------------------


def _flow_steps(spark, sf):
    lines = star.table(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("flow"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("id"), F.col("l_linenumber").alias("sequence"))
    flows = lines.groupBy(F.col("flow").alias("id")).agg(F.collect_set("id").alias("steps"))
    return views.flow_steps(flows, lines.select("id", "sequence").distinct())


_STEPS = "WITH s AS (SELECT DISTINCT 'o' || l_orderkey AS flow, 'o' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS step, l_linenumber AS sequence FROM lineitem), w AS (SELECT flow, step, row_number() OVER (PARTITION BY flow ORDER BY sequence, step) - 1 AS position, lead(step) OVER (PARTITION BY flow ORDER BY sequence, step) AS next FROM s) "


@query(_STEPS + "SELECT flow, step, position FROM w")
def behaviour_flow_steps(spark, sf):
    return _flow_steps(spark, sf).select("flow", "step", "position")


@query(_STEPS + "SELECT flow, step, next FROM w WHERE next IS NOT NULL")
def flow_then_arrows(spark, sf):
    return _flow_steps(spark, sf).where("next is not null").select("flow", "step", "next")


# --- gates ----------------------------------------------------------------------------------------------------------------

_LINKS = GRAPH + """, links AS (
  SELECT 'x' || l_orderkey || '-' || l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN 'belongsTo' WHEN l_linenumber % 3 = 1 THEN 'consumes' ELSE 'evaluates' END AS type,
    CASE WHEN l_linenumber % 3 = 1 THEN 's' || l_suppkey ELSE 'c' || (l_orderkey % 200) END AS source_id, CASE WHEN l_partkey % 11 = 0 THEN 'gone' ELSE 'n' || (l_suppkey % 25) END AS target_id, l_orderkey * 100 + l_linenumber AS ord
  FROM lineitem),
judged AS (
  SELECT l.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'dangling' WHEN l.type = 'consumes' AND a.type NOT IN ('Decision', 'Service') THEN 'source type' WHEN l.type = 'evaluates' AND a.type <> 'Decision' THEN 'source type'
    WHEN l.type = 'consumes' THEN 'target type' END AS early
  FROM links l LEFT JOIN nodes a ON a.id = l.source_id LEFT JOIN nodes b ON b.id = l.target_id),
gated AS (
  SELECT id, type, source_id, target_id, CASE WHEN early IS NOT NULL THEN early WHEN type = 'belongsTo' AND row_number() OVER (PARTITION BY source_id, type, early ORDER BY ord, id) > 1 THEN 'cardinality' END AS reason FROM judged) """


def _gated(spark, sf):
    n, kind = F.col("l_linenumber") % 3, None
    kind = F.when(n == 0, "belongsTo").when(n == 1, "consumes").otherwise("evaluates")
    s = lambda c: F.col(c).cast("string")
    links = star.table(spark, sf, "lineitem").select(
        F.concat(F.lit("x"), s("l_orderkey"), F.lit("-"), s("l_linenumber")).alias("id"), kind.alias("type"), F.when(n == 1, F.concat(F.lit("s"), s("l_suppkey"))).otherwise(F.concat(F.lit("c"), (F.col("l_orderkey") % 200).cast("string"))).alias("source_id"),
        F.when(F.col("l_partkey") % 11 == 0, "gone").otherwise(F.concat(F.lit("n"), (F.col("l_suppkey") % 25).cast("string"))).alias("target_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ord"),
    )
    return gates.link_gate(links, star.nodes(spark, sf))


@query(_LINKS + "SELECT id, source_id, target_id FROM gated WHERE reason = 'dangling'")
def dangling_edges(spark, sf):
    return _gated(spark, sf).where("reason = 'dangling'").select("id", "source_id", "target_id")


@query(_LINKS + "SELECT id, type, reason FROM gated WHERE reason IN ('source type', 'target type')")
def endpoint_type_mismatch(spark, sf):
    return _gated(spark, sf).where("reason in ('source type', 'target type')").select("id", "type", "reason")


@query(_LINKS + "SELECT source_id, count(*) AS n FROM gated WHERE reason = 'cardinality' GROUP BY source_id")
def cardinality_quarantine(spark, sf):
    return _gated(spark, sf).where("reason = 'cardinality'").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


@query(_LINKS + ", t AS (SELECT CASE WHEN reason IS NULL THEN 'loaded' ELSE 'quarantined' END AS status, count(*) AS n FROM gated GROUP BY 1) SELECT status, n, CAST(sum(n) OVER () AS BIGINT) AS total FROM t")
def load_status_totals(spark, sf):
    return gates.status_totals(_gated(spark, sf))


@query("WITH o AS (SELECT 'd' || o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'automated' ELSE 'manual' END AS kind FROM orders), e AS (SELECT 'd' || l_orderkey AS id, count_if(l_linenumber = 2) AS evaluates, count_if(l_linenumber = 3) AS produces, count_if(l_linenumber = 4) AS triggers FROM lineitem GROUP BY 1) SELECT o.id, (CASE WHEN coalesce(evaluates, 0) = 0 THEN 'evaluates nothing;' ELSE '' END) || (CASE WHEN coalesce(produces, 0) = 0 THEN 'produces nothing;' ELSE '' END) || (CASE WHEN kind = 'automated' AND coalesce(triggers, 0) = 0 THEN 'is triggered by nothing;' ELSE '' END) AS violations FROM o LEFT JOIN e ON e.id = o.id")
def decision_min_cardinality(spark, sf):
    orders = star.table(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "O", "automated").otherwise("manual").alias("decision_type"))
    line = star.table(spark, sf, "lineitem").withColumn("d", F.concat(F.lit("d"), F.col("l_orderkey").cast("string")))
    n = F.col("l_linenumber")
    edges = line.where(n.isin(2, 3, 4)).select(F.when(n == 2, "evaluates").when(n == 3, "produces").otherwise("triggeredBy").alias("type"), F.when(n == 4, "other").otherwise(F.col("d")).alias("source_id"), F.when(n == 4, F.col("d")).otherwise("other").alias("target_id"))
    return gates.decision_integrity(orders, edges).select("id", F.array_join(F.transform("violations", lambda v: F.concat(v, F.lit(";"))), "").alias("violations"))


@query("SELECT p_partkey AS id, CASE WHEN NOT (p_size * 1.0 / 50 >= 0.5) THEN 'confidence' WHEN NOT (regexp_matches(p_brand, '^Brand#[0-9]$') AND p_retailprice >= 950) THEN 'shape' END AS reason, CASE WHEN p_size * 1.0 / 50 >= 0.5 AND regexp_matches(p_brand, '^Brand#[0-9]$') AND p_retailprice >= 950 THEN 'emitted' ELSE 'excluded' END AS status FROM part")
def emit_gate_schema(spark, sf):
    rows = star.table(spark, sf, "part").withColumn("confidence", F.col("p_size") / 50)
    valid = gates.schema_check({"required": ["p_name"], "properties": {"p_brand": {"pattern": "^Brand#[0-9]$", "minLength": 1}, "p_retailprice": {"minimum": 950}}})
    return gates.emit_gate(rows, 0.5, valid).select(F.col("p_partkey").alias("id"), "reason", "status")


@query("SELECT l_orderkey AS entry_id, 'run-' || l_linenumber AS run_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND l_linenumber <= 2)")
def idempotent_replay(spark, sf):
    rows = star.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.concat(F.lit("run-"), F.col("l_linenumber").cast("string")).alias("run_id"))
    done = star.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("entry_id"), F.explode(F.array(F.lit("run-1"), F.lit("run-2"))).alias("run_id"))
    return gates.not_replayed(rows, done)


@query("SELECT o_orderkey AS id, o_orderpriority AS run_id FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT'")
def rollback_run(spark, sf):
    return gates.rolled_back(star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("run_id")), "1-URGENT")


@query("SELECT a.s AS before, b.s AS after, (a.s = b.s OR (a.s = 'draft' AND b.s IN ('active', 'retired')) OR (a.s = 'active' AND b.s IN ('deprecated', 'retired')) OR (a.s = 'deprecated' AND b.s IN ('active', 'retired'))) AS allowed FROM (SELECT CASE n_nationkey WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'deprecated' ELSE 'retired' END AS s FROM nation WHERE n_nationkey < 4) a, (SELECT CASE n_nationkey WHEN 0 THEN 'draft' WHEN 1 THEN 'active' WHEN 2 THEN 'deprecated' ELSE 'retired' END AS s FROM nation WHERE n_nationkey < 4) b")
def lifecycle_transitions(spark, sf):
    pairs = spark.createDataFrame([(a, b) for a in gates.LIFECYCLE for b in gates.LIFECYCLE], "before string, after string")
    return pairs.withColumn("allowed", gates.lifecycle_allowed(F.col("before"), F.col("after")))


# --- the log -------------------------------------------------------------------------------------------------------------

_LOG = "WITH log AS (SELECT user_id AS entity_id, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS state, event_type, value FROM events) "


@query(_LOG + f", r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, seq DESC) AS k FROM log WHERE ts <= TIMESTAMP '{MOMENT}') SELECT entity_id, state FROM r WHERE k = 1 AND state IS NOT NULL")
def state_at_time(spark, sf):
    return temporal.state_at(star.log(spark, sf), MOMENT)


@query(_LOG + f", a AS (SELECT entity_id, state FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, seq DESC) AS k FROM log WHERE ts <= TIMESTAMP '{MOMENT}') x WHERE k = 1 AND state IS NOT NULL), b AS (SELECT entity_id, state FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, seq DESC) AS k FROM log WHERE ts <= TIMESTAMP '{LATER}') x WHERE k = 1 AND state IS NOT NULL) SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, CASE WHEN a.entity_id IS NULL THEN 'added' WHEN b.entity_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.entity_id = b.entity_id WHERE a.entity_id IS NULL OR b.entity_id IS NULL OR a.state <> b.state")
def entity_diff(spark, sf):
    return temporal.difference(star.log(spark, sf), MOMENT, LATER)


@query(_LOG + ", p AS (SELECT *, lag(state) OVER w AS before, row_number() OVER w AS k FROM log WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq)), c AS (SELECT * FROM p WHERE k = 1 OR state IS DISTINCT FROM before) SELECT entity_id, row_number() OVER w AS revision, ts AS tx_from, lead(ts) OVER w AS tx_to, state FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY ts, seq)")
def node_versions_scd2(spark, sf):
    return temporal.versions(star.log(spark, sf))


@query(_LOG + f"SELECT seq, entity_id, value FROM log WHERE ts BETWEEN TIMESTAMP '{MOMENT}' AND TIMESTAMP '{LATER}' AND event_type = 'purchase'")
def event_filter_range(spark, sf):
    return temporal.in_range(star.log(spark, sf), MOMENT, LATER, event_type="purchase").select("seq", "entity_id", "value")


@query("SELECT coalesce(c.id, i.id) AS id, CASE WHEN i.id IS NULL THEN 'keep' WHEN c.id IS NULL THEN 'create' WHEN c.state = i.state THEN 'none' ELSE 'update' END AS action, CASE WHEN c.id IS NULL THEN 1 WHEN i.id IS NULL OR c.state = i.state THEN 1 ELSE 2 END AS revision, coalesce(i.state, c.state) AS state FROM (SELECT c_custkey AS id, c_mktsegment AS state FROM customer WHERE c_acctbal > 0) c FULL JOIN (SELECT o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN 'BUILDING' ELSE 'MACHINERY' END) AS state FROM orders WHERE o_totalprice > 200000 GROUP BY 1) i ON c.id = i.id")
def upsert_merge(spark, sf):
    current = star.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.lit(1).alias("revision"), F.col("c_mktsegment").alias("state"))
    incoming = star.table(spark, sf, "orders").where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.when(F.col("o_orderstatus") == "F", "BUILDING").otherwise("MACHINERY")).alias("state"))
    return temporal.upsert(current, incoming)


@query(GRAPH + "SELECT 'EdgeRemoved' AS kind, id AS entity_id, 1 AS step FROM edges WHERE source_id IN ('n1', 's5') OR target_id IN ('n1', 's5') UNION ALL SELECT 'NodeRetired', id, 2 FROM nodes WHERE id IN ('n1', 's5')")
def hard_remove_events(spark, sf):
    nodes, edges = _both(spark, sf)
    return temporal.removed(nodes, edges, nodes.where("id in ('n1', 's5')"))[2]


# --- entity resolution ---------------------------------------------------------------------------------------------------------


def _entities(spark, sf):
    part = star.table(spark, sf, "part")
    return part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_type").alias("type"), F.concat(F.col("p_brand"), F.lit(" The "), F.col("p_name")).alias("name"), (F.col("p_size") / 50).alias("confidence"), F.array(F.concat(F.lit("ev"), (F.col("p_partkey") % 7).cast("string"))).alias("evidence"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("brand"))


_RESOLVED = "WITH e AS (SELECT 'p' || p_partkey AS id, p_type AS type, lower(replace(p_brand, '#', ' ')) AS k, p_size / 50.0 AS confidence, 'ev' || (p_partkey % 7) AS ev, p_partkey AS ord FROM part) "


@query(_RESOLVED + "SELECT arg_min(id, ord) AS id, type, max(confidence) AS confidence, count(*) AS members, count(DISTINCT ev) AS evidence FROM e GROUP BY type, k")
def entity_resolution_exact(spark, sf):
    entities = _entities(spark, sf).withColumn("name", F.regexp_replace("brand", "#", " -- "))
    return resolution.resolve_exact(entities)[0].select("id", "type", "confidence", "members", F.size("evidence").cast("long").alias("evidence"))


@query("WITH s AS (SELECT 'p' || p_partkey AS id, 'p' || min(p_partkey) OVER (PARTITION BY p_type, p_brand) AS survivor FROM part) SELECT 'shipsWith' AS type, a.survivor AS source_id, b.survivor AS target_id, count(DISTINCT l.l_orderkey % 5) AS evidence FROM lineitem l JOIN s a ON a.id = 'p' || l.l_partkey JOIN s b ON b.id = 'p' || (l.l_suppkey * 7 % 100) WHERE a.survivor <> b.survivor GROUP BY ALL")
def edge_dedupe_remap(spark, sf):
    entities = _entities(spark, sf).withColumn("name", F.col("brand"))
    _, remap = resolution.resolve_exact(entities)
    p = lambda c: F.concat(F.lit("p"), c.cast("string"))
    edges = star.table(spark, sf, "lineitem").select(F.concat(p(F.col("l_orderkey")), p(F.col("l_linenumber"))).alias("id"), F.lit("shipsWith").alias("type"), p(F.col("l_partkey")).alias("source_id"), p(F.col("l_suppkey") * 7 % 100).alias("target_id"), F.array(F.col("l_orderkey") % 5).alias("evidence"))
    edges = edges.join(entities.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return resolution.remap_edges(edges, remap).select("type", "source_id", "target_id", F.size("evidence").cast("long").alias("evidence"))


def _texts(spark, sf):
    return star.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("lang", F.lit("und")).alias("type"), F.col("text").alias("name"))


@query()
def blocking_pairs_jaccard(spark, sf):
    """Whole texts as names, with the members of each class of equal token sets; too many tokens for SQL, so a test holds it against brute force."""
    return resolution.similar_links(_texts(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"), "kind")


@query()
def blocking_components(spark, sf):
    return resolution.candidate_blocks(_texts(spark, sf))


@query("SELECT type, CAST(floor((row_number() OVER (ORDER BY name, id) - 1) / 40) AS INT) AS batch, id, name FROM (SELECT 'p' || p_partkey AS id, p_type AS type, p_name AS name FROM part WHERE p_size <= 40) x")
def classification_batches(spark, sf):
    entities = _entities(spark, sf).drop("name").join(star.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name")), "id")
    done = entities.where("confidence > 0.8").select(F.col("id").alias("subject"))
    return resolution.classification_batches(entities, done)


# --- scalar functions ------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(lower(p_brand || ' / ' || p_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM part")
def normalise_name(spark, sf):
    return star.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.normalise_name(F.concat(F.col("p_brand"), F.lit(" / "), F.col("p_name"))).alias("name"))


@query("SELECT id, coalesce(string_agg(t, ' ' ORDER BY k), '') AS tokens FROM (SELECT id, t, min(i) AS k FROM (SELECT id, i, CASE WHEN length(t) > 3 AND right(t, 1) = 's' THEN left(t, length(t) - 1) ELSE t END AS t FROM (SELECT c_custkey AS id, unnest(string_split(lower(regexp_replace('The ' || c_mktsegment || ' customers of ' || c_name, '[^A-Za-z0-9]+', ' ', 'g')), ' ')) AS t, unnest(range(20)) AS i FROM customer) x WHERE t IS NOT NULL AND length(t) >= 3 AND t NOT IN ('the', 'and', 'for', 'with', 'our', 'its')) y GROUP BY id, t) z GROUP BY id")
def salient_tokens(spark, sf):
    name = F.concat(F.lit("The "), F.col("c_mktsegment"), F.lit(" customers of "), F.col("c_name"))
    return star.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array_join(tx.salient_tokens(name), " ").alias("tokens"))


@query("SELECT l_orderkey AS id, l_linenumber AS n, CASE l_linenumber % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'full' WHEN 2 THEN 'partial' WHEN 3 THEN 'none' WHEN 4 THEN NULL WHEN 5 THEN 'full' ELSE 'partial' END AS coverage FROM lineitem")
def coverage_normalise(spark, sf):
    prose = F.array(*map(F.lit, ["No coverage at all", "Fully supported", "Limited to cards", "not covered", "unclear", "uncovered", " PARTIAL "]))
    return star.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), tx.normalise_coverage(F.element_at(prose, (F.col("l_linenumber") % 7 + 1).cast("int"))).alias("coverage"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf):
    return star.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 101 / 100.0 >= 0.8 THEN 'High' WHEN s_suppkey % 101 / 100.0 >= 0.5 THEN 'Medium' ELSE 'Low' END || ' (' || CAST(s_suppkey % 101 AS INT) || '%)' AS label FROM supplier")
def confidence_labels(spark, sf):
    return star.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), tx.confidence_label(F.round(F.col("s_suppkey") % 101 / 100, 2)).alias("label"))


# --- documents ---------------------------------------------------------------------------------------------------------------


@query("SELECT hash, min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents) x GROUP BY hash")
def content_hash_dedupe(spark, sf):
    return files.dedupe_by_content(star.table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT 'd' || doc_id AS path, CASE WHEN lang IN ('en', 'es') THEN 'skipped' ELSE 'fetched' END AS status FROM documents")
def incremental_ingest(spark, sf):
    """English ones are as before, Spanish ones touched, German ones changed, French ones new."""
    found = star.table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.lit(7).alias("modified"), F.col("n_chars").alias("length"), tx.content_hash(F.col("text")).alias("hash"), "lang")
    old = found.where("lang <> 'fr'").select("path", F.when(F.col("lang") == "en", 7).otherwise(1).alias("modified"), "length", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")).alias("hash"))
    return files.incremental(found, old)[0].select("path", "status")


_HEADS = r"""WITH d AS (SELECT doc_id AS id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '(^|\n)The ', '\1# The ', 'g'), '(^|\n)It ', '\1```', 'g'), chr(10)) AS ls FROM documents),
l AS (SELECT id, unnest(ls) AS v, unnest(range(len(ls))) AS line FROM d),
o AS (SELECT id, v, line, count_if(regexp_matches(v, '^\s*(```|~~~)')) OVER w % 2 = 1 AS fenced, coalesce(sum(length(v) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, max(line) OVER (PARTITION BY id) + 1 AS last, sum(length(v) + 1) OVER (PARTITION BY id) - 1 AS total FROM l WINDOW w AS (PARTITION BY id ORDER BY line)),
h AS (SELECT *, NOT fenced AND regexp_matches(v, '^#{1,6}\s') AS head FROM o),
c AS (SELECT *, count_if(head) OVER (PARTITION BY id) AS heads FROM h),
k AS (SELECT * FROM c WHERE head OR (heads = 0 AND line = 0))
SELECT id, row_number() OVER w - 1 AS index, CASE WHEN head THEN length(regexp_extract(v, '^(#{1,6})\s', 1)) ELSE 1 END AS level, CAST(line AS INT) AS start, CAST(coalesce(lead(line) OVER w, last) AS INT) AS "end", CAST(pos AS BIGINT) AS start_offset, CAST(coalesce(lead(pos) OVER w, total) AS BIGINT) AS end_offset
FROM k WINDOW w AS (PARTITION BY id ORDER BY line)"""


@query(_HEADS)
def markdown_sections(spark, sf):
    """Lines that begin with The are headings, those that begin with It fences."""
    marked = F.regexp_replace(F.regexp_replace("text", "(^|\n)The ", "$1# The "), "(^|\n)It ", "$1```")
    docs = star.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), marked.alias("content"))
    return docs_f.sections(docs).drop("title")


@query()
def paragraph_chunks(spark, sf):
    docs = star.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "\n", "\n\n").alias("content"))
    return docs_f.paragraph_chunks(docs).select("id", "index", F.length("content").alias("length"))


# --- quality and evaluation ------------------------------------------------------------------------------------------------------


def _dimensions():
    k = F.col("c_custkey")
    return {
        "accuracy": q.clamp(k % 11 / 10),
        "completeness": q.completeness(q.present(F.col("c_name")), F.col("c_acctbal") > 0),
        "consistency": q.consistency(k % 3),
        "timeliness": q.timeliness(k % 200, F.when(k % 2 == 0, "Service").otherwise("Other")),
        "provenance": (k % 7 > 0).cast("double"),
        "confidence": q.clamp(k % 101 / 100),
    }


_QUALITY = "WITH d AS (SELECT c_custkey AS id, (c_custkey % 11) / 10.0 AS accuracy, (1 + CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / 2.0 AS completeness, greatest(0.0, 1 - 0.25 * (c_custkey % 3)) AS consistency, exp(-(CASE WHEN c_custkey % 2 = 0 THEN 0.02 ELSE 0.005 END) * (c_custkey % 200)) AS timeliness, CASE WHEN c_custkey % 7 > 0 THEN 1.0 ELSE 0.0 END AS provenance, (c_custkey % 101) / 100.0 AS confidence FROM customer), s AS (SELECT *, floor((0.25 * accuracy + 0.15 * completeness + 0.2 * consistency + 0.15 * timeliness + 0.15 * provenance + 0.1 * confidence) * 1000000 + 0.5) / 1000000 AS score FROM d) "


@query(_QUALITY + "SELECT id, score, CASE WHEN score >= 0.8 THEN 'auto-publish' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS policy FROM s")
def quality_composite(spark, sf):
    rows = star.table(spark, sf, "customer").withColumn("score", q.composite(_dimensions()))
    return rows.select(F.col("c_custkey").alias("id"), "score", q.policy(F.col("score")).alias("policy"))


@query(_QUALITY + "SELECT CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.8 THEN 'good' WHEN score >= 0.6 THEN 'acceptable' ELSE 'poor' END AS bucket, count(*) AS n, round(avg(timeliness), 5) AS timeliness FROM s GROUP BY 1")
def quality_histogram(spark, sf):
    d = _dimensions()
    rows = star.table(spark, sf, "customer").select(q.composite(d).alias("score"), d["timeliness"].alias("timeliness"))
    return rows.groupBy(q.bucket(F.col("score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("timeliness"), 5).alias("timeliness"))


@query("SELECT s_suppkey AS id, round(exp(-(CASE WHEN s_suppkey % 2 = 0 THEN 0.02 ELSE 0.005 END) * (s_suppkey % 300)), 6) AS timeliness FROM supplier")
def timeliness_decay(spark, sf):
    k = F.col("s_suppkey")
    return star.table(spark, sf, "supplier").select(k.alias("id"), F.round(q.timeliness(k % 300, F.when(k % 2 == 0, "Event").otherwise("Rule")), 6).alias("timeliness"))


@query("WITH b AS (SELECT p_type AS kind, p_size > 15 AS ip, p_retailprice > 930 AS ig FROM part), c AS (SELECT kind, count_if(ip AND ig) AS tp, count_if(ip AND NOT ig) AS fp, count_if(NOT ip AND ig) AS fn FROM b GROUP BY GROUPING SETS ((), (kind))) SELECT kind, tp, fp, fn, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def prf_overall_and_per_type(spark, sf):
    part = star.table(spark, sf, "part").select(F.col("p_type").alias("kind"), "p_partkey", "p_size", "p_retailprice")
    out = evaluation.precision_recall(part.where("p_size > 15"), part.where("p_retailprice > 930"), ["kind", "p_partkey"], "kind")
    return out.select("kind", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT count(*) AS n, round(1 - avg(abs(p_size / 50.0 - CASE WHEN p_retailprice > 930 THEN 1 ELSE 0 END)), 6) AS calibration FROM part")
def confidence_calibration(spark, sf):
    judged = star.table(spark, sf, "part").select((F.col("p_size") / 50).alias("confidence"), (F.col("p_retailprice") > 930).alias("correct"))
    return evaluation.calibration(judged).withColumn("calibration", F.round("calibration", 6))


@query("SELECT count(*) AS n, round(avg(CASE WHEN p_retailprice > 930 THEN 1.0 ELSE 0.0 END), 6) AS band_precision FROM part WHERE p_size / 50.0 >= 0.8")
def band_precision(spark, sf):
    judged = star.table(spark, sf, "part").select((F.col("p_size") / 50).alias("confidence"), (F.col("p_retailprice") > 930).alias("correct"))
    return evaluation.band_precision(judged).withColumn("band_precision", F.round("band_precision", 6))


# --- search ---------------------------------------------------------------------------------------------------------------------


@query("WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings), d AS (SELECT vec_id, sum(CAST(x AS DOUBLE) * (CASE WHEN i % 2 = 0 THEN 1.0 ELSE -0.5 END)) / (sqrt(sum(CAST(x AS DOUBLE) * x)) * sqrt(32 * 1.0 + 32 * 0.25)) AS score FROM v GROUP BY vec_id) SELECT vec_id, round(score, 5) AS score FROM d ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, sf):
    wanted = [1.0 if i % 2 == 0 else -0.5 for i in range(64)]
    return search.vector_top(star.table(spark, sf, "embeddings"), wanted, 20, "vec_id").select("vec_id", F.round("score", 5).alias("score"))


_RRF = "WITH k AS (SELECT 'c' || c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, 'c' || c_custkey) AS r FROM customer QUALIFY r <= 50), b AS (SELECT 'c' || c_custkey AS id, row_number() OVER (ORDER BY c_acctbal * (c_custkey % 3) DESC, 'c' || c_custkey) AS r FROM customer QUALIFY r <= 50) SELECT id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM b) x GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 30"


@query(_RRF)
def hybrid_rrf(spark, sf):
    rows = star.table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_acctbal", "c_custkey")
    top = lambda score: rows.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(50)
    return search.fused([top(F.col("c_acctbal")), top(F.col("c_acctbal") * (F.col("c_custkey") % 3))], 30).select("id", F.round("score", 8).alias("score"))


@query(f"WITH {NODES_SQL} SELECT id, (CASE WHEN lower(name) LIKE '%united%' THEN 1 ELSE 0 END) + (CASE WHEN lower(name) LIKE '%kingdom%' THEN 1 ELSE 0 END) AS score FROM nodes WHERE type = 'BoundedContext' AND (lower(name) LIKE '%united%' OR lower(name) LIKE '%kingdom%') ORDER BY score DESC, id LIMIT 5")
def keyword_top(spark, sf):
    return search.keyword_top(star.nodes(spark, sf).where("type = 'BoundedContext'"), "United Kingdom", 5)


# --- displays, reports, extraction ----------------------------------------------------------------------------------------------------


@query(f"WITH {NODES_SQL} SELECT type, CASE WHEN type = 'Service' THEN 'L3' ELSE 'L1' END AS layer, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM nodes GROUP BY type")
def type_summary(spark, sf):
    return display.type_summary(star.nodes(spark, sf)).withColumn("share", F.round("share", 6))


@query(f"WITH {NODES_SQL} SELECT CASE WHEN type = 'Service' THEN 'L3' ELSE 'L1' END AS layer, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS n FROM nodes GROUP BY 1")
def concept_model(spark, sf):
    return display.concept_model(star.nodes(spark, sf)).withColumn("types", F.array_join("types", ","))


@query(GRAPH + "SELECT type, direction, count(*) AS n FROM (SELECT type, 'out' AS direction FROM edges WHERE source_id = 'n3' UNION ALL SELECT type, 'in' FROM edges WHERE target_id = 'n3' AND source_id <> 'n3') e GROUP BY ALL")
def relationship_groups(spark, sf):
    return display.relationship_groups(lookup.entry_detail(*_both(spark, sf), "n3"))


@query(f"WITH {NODES_SQL} SELECT id FROM nodes WHERE type = 'BoundedContext' ORDER BY id LIMIT 5")
def seed_probe(spark, sf):
    return display.seeds(star.nodes(spark, sf), ["OrchestrationFlow", "BoundedContext", "Service"])


@query(GRAPH + ", s AS (SELECT id FROM nodes WHERE type = 'Subdomain'), a AS (SELECT DISTINCT source_id AS id FROM edges JOIN s ON target_id = s.id AND type = 'belongsTo'), b AS (SELECT DISTINCT source_id AS id FROM edges JOIN a ON target_id = a.id AND type = 'belongsTo') SELECT id, min(depth) AS depth FROM (SELECT id, 0 AS depth FROM s UNION ALL SELECT id, 1 FROM a UNION ALL SELECT id, 2 FROM b) x GROUP BY id")
def multi_seed_bfs(spark, sf):
    nodes, edges = _both(spark, sf)
    return graph.traverse(nodes, edges, nodes.where("type = 'Subdomain'"), "in", ["belongsTo"], depth=3)[0]


@query("SELECT 'p' || min(p_partkey) AS survivor, count(*) - 1 AS n FROM part GROUP BY p_type, p_brand HAVING count(*) > 1")
def merge_report(spark, sf):
    entities = _entities(spark, sf).withColumn("name", F.col("brand"))
    return display.merge_report(resolution.resolve_exact(entities)[1], entities).select("survivor", "n")


_SCORES = "WITH s AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, greatest(0.0, c_acctbal / 10000.0) AS score, c_custkey % 13 / 13.0 AS other FROM customer) "


def _scores(spark, sf):
    c = star.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000).alias("score"), (F.col("c_custkey") % 13 / 13).alias("other"))


@query(_SCORES + "SELECT * FROM (SELECT 'score' AS dimension, id, round(score, 6) AS value FROM s ORDER BY score, id LIMIT 10) a UNION ALL SELECT * FROM (SELECT 'other', id, round(other, 6) FROM s ORDER BY other, id LIMIT 10) b")
def worst_per_dimension(spark, sf):
    return display.worst_per_dimension(_scores(spark, sf), ["score", "other"]).withColumn("value", F.round("value", 6))


@query(_SCORES + "SELECT segment, nation, count(*) AS n, round(avg(score), 6) AS score FROM s GROUP BY GROUPING SETS ((), (segment), (nation))")
def quality_drill_down(spark, sf):
    return display.drill_down(_scores(spark, sf), ["segment", "nation"]).withColumn("score", F.round("score", 6))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n, round(avg(value), 5) AS score FROM events GROUP BY 1")
def quality_trend(spark, sf):
    rows = star.table(spark, sf, "events").select("ts", F.col("value").alias("score"))
    return display.trend(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("score", 5).alias("score"))


@query("SELECT o_orderpriority AS source, count(*) AS n, min(o_orderdate) AS oldest FROM orders WHERE o_orderdate < TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 365 DAY GROUP BY 1")
def staleness_report(spark, sf):
    rows = star.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("evidenced_at"))
    return display.stale(rows, "1998-08-02 00:00:00", 365)


_CLAIMS = "WITH c AS (SELECT o_custkey AS subject, 'status' AS field, o_orderstatus AS value, o_orderdate AS valid_from, o_orderdate + INTERVAL 30 DAY AS valid_to, o_totalprice AS authority FROM orders), h AS (SELECT DISTINCT a.subject FROM c a JOIN c b ON a.subject = b.subject AND a.value <> b.value AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to) "


@query(_CLAIMS + "SELECT subject, field, count(DISTINCT value) AS kinds, arg_max(value, authority) AS kept FROM c WHERE subject IN (SELECT subject FROM h) GROUP BY subject, field")
def contradictions(spark, sf):
    o = star.table(spark, sf, "orders")
    claims = o.select(F.col("o_custkey").alias("subject"), F.lit("status").alias("field"), F.col("o_orderstatus").alias("value"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("valid_to"), F.col("o_totalprice").alias("authority"), F.col("o_orderdate").alias("stated_at"), F.lit(1.0).alias("confidence"))
    return display.contradictions(claims)


@query("SELECT CAST(conv_id AS VARCHAR) AS document, CAST(turn AS VARCHAR) AS section, role AS type, length(text) AS length FROM conversations WHERE text IS NOT NULL")
def scripted_extraction(spark, sf):
    turns = star.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("document"), F.col("turn").cast("string").alias("section"), "role", "text")
    script = turns.where("text is not null").select("document", "section", F.col("role").alias("type"))
    return extraction.scripted(turns.select("document", "section", "text"), script).select("document", "section", "type", F.length("text").alias("length"))


@query("SELECT 'p' || p_partkey AS id, CASE WHEN trim(p_name || ' ' || p_type) <> '' THEN p_name || ' ' || p_type ELSE '{}' END AS text FROM part")
def vector_load_text(spark, sf):
    entries = star.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("Part").alias("type"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit("{}").alias("data"))
    return extraction.vector_rows(entries).select("id", "text")


@query("SELECT l_returnflag AS run_id, l_linestatus AS type, count(*) AS n FROM lineitem GROUP BY ALL")
def ingestion_history(spark, sf):
    return star.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run_id"), F.col("l_linestatus").alias("type")).agg(F.count(F.lit(1)).alias("n"))


# --- streams, run as tables ---------------------------------------------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_event_counts(spark, sf):
    return ingest.windowed_counts(star.table(spark, sf, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    return ingest.sessions(star.table(spark, sf, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap analysis end to end."""
    return gap_list(spark, sf_dir)


def _all() -> None:
    """The module of further queries registers its own when it is imported."""
    from . import registry_more  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(ORACLES)
