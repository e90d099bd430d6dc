"""Further queries over the star schema: mapping, the write side, gates of edges, views as a whole, extensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import documents as docs_f
from .functions import jsonschema
from .functions import quality as q
from .functions import text as tx
from .operators import dependencies, display, evaluation, extraction, gates, graph, mapping, patterns, resolution, search, store, textindex, vectorindex
from .plans import service, upkeep, views
from .plans.tables import new_path, settled
from .registry import _CROSS, _LINKS, _SCORES, _TREE, COVER, GRAPH, _both, _entities, _gated, _scores, query
from .sources import star


def _s(column: str):
    return F.col(column).cast("string")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), _s(column))


# --- entries to nodes and edges -----------------------------------------------------------------------------


def _source(file):
    return F.struct(file.alias("file"), F.lit("L1").alias("location"), F.lit("2024-02-01").alias("fetchedAt"), F.lit("vendor").alias("sourceAuthority"))


@query("SELECT 'c' || c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'draft' ELSE 'active' END AS lifecycle_status, CASE WHEN c_custkey % 5 = 0 THEN '2023-05-01' ELSE '2024-01-01' END AS valid_from, c_name AS name, 'f' || (c_custkey % 4) AS source, CAST(c_custkey % 101 AS DOUBLE) / 100 AS confidence FROM customer")
def entry_node_mapping(spark, sf):
    k = F.col("c_custkey")
    data = F.parse_json(F.to_json(F.struct(F.col("c_name").alias("name"), F.when(k % 3 == 0, "draft").alias("lifecycle_status"), F.when(k % 5 == 0, "2023-05-01").alias("validFrom"))))
    entries = star.table(spark, sf, "customer").select(
        _id("c", "c_custkey").alias("id"), F.lit("DomainConcept").alias("type"), F.lit("1.0.0").alias("version"), _source(F.concat(F.lit("f"), (k % 4).cast("string"))).alias("source"),
        (k % 101 / 100).alias("confidence"), F.lit("2024-01-01").alias("extractedAt"), data.alias("data"),
    )
    return mapping.entry_nodes(entries).select("id", "lifecycle_status", "valid_from", "name", F.col("evidence")[0]["source"].alias("source"), "confidence")


@query("SELECT 'o' || o_orderkey AS id, CASE WHEN o_orderkey % 7 > 0 THEN 'consumes' END AS type, 'c' || o_custkey AS source_id, CASE WHEN o_orderkey % 11 > 0 THEN 's' || (o_orderkey % 10) ELSE '' END AS target_id, CASE WHEN o_orderkey % 77 = 0 THEN 'missing relationshipType/targetEntityId' WHEN o_orderkey % 7 = 0 THEN 'missing relationshipType' WHEN o_orderkey % 11 = 0 THEN 'missing targetEntityId' END AS problem FROM orders")
def entry_edge_mapping(spark, sf):
    k = F.col("o_orderkey")
    data = F.parse_json(F.to_json(F.struct(F.when(k % 7 > 0, "consumes").alias("relationshipType"), _id("c", "o_custkey").alias("sourceEntityId"), F.when(k % 11 > 0, F.concat(F.lit("s"), (k % 10).cast("string"))).otherwise("").alias("targetEntityId"))))
    entries = star.table(spark, sf, "orders").select(_id("o", "o_orderkey").alias("id"), F.lit("Relationship").alias("type"), F.lit("1.0.0").alias("version"), _source(F.lit("f")).alias("source"), F.lit(0.5).alias("confidence"), data.alias("data"))
    return mapping.entry_edges(entries).select("id", "type", "source_id", "target_id", "problem")


# --- the write side -------------------------------------------------------------------------------------------

_OPS = "ops AS (SELECT o_orderkey AS seq, 'c' || o_custkey AS id, CASE o_orderstatus WHEN 'F' THEN 'BUILDING' WHEN 'O' THEN 'MACHINERY' ELSE 'FURNITURE' END AS state FROM orders), lined AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seq) AS before, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM (SELECT -1 AS seq, 'c' || c_custkey AS id, c_mktsegment AS state FROM customer UNION ALL SELECT * FROM ops) x) "


def _empty_edges(spark):
    return spark.createDataFrame([], "id string, type string, source_id string, target_id string, ord long")


def _upserted(spark, sf):
    nodes = star.table(spark, sf, "customer").select(_id("c", "c_custkey").alias("id"), F.lit(1).cast("long").alias("revision"), F.col("c_mktsegment").alias("state"))
    state = F.when(F.col("o_orderstatus") == "F", "BUILDING").when(F.col("o_orderstatus") == "O", "MACHINERY").otherwise("FURNITURE")
    none = F.lit(None).cast("string")
    ops = star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.lit("upsert").alias("kind"), _id("c", "o_custkey").alias("id"), state.alias("state"), F.lit(None).cast("long").alias("expected_revision"), none.alias("type"), none.alias("source_id"), none.alias("target_id"))
    return store.commit(nodes, _empty_edges(spark), ops)


@query("WITH " + _OPS + "SELECT id, 1 + count_if(k > 1 AND state IS DISTINCT FROM before) AS revision, arg_max(state, seq) AS state FROM lined GROUP BY id")
def transaction_nodes(spark, sf):
    """Customers after one batch of an upsert for every order, in order."""
    return _upserted(spark, sf)["nodes"]


@query("WITH " + _OPS + "SELECT seq, 'NodeUpdated' AS kind, id AS entity_id, before, state AS after FROM lined WHERE k > 1 AND state IS DISTINCT FROM before")
def transaction_events(spark, sf):
    return _upserted(spark, sf)["events"]


def _moved(spark, sf, faults: bool):
    """A batch that moves suppliers to the next nation: remove the old edge, create the new one."""
    s = star.table(spark, sf, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    nation = lambda c: F.concat(F.lit("n"), c.cast("string"))
    edges = s.select(_id("e", "s_suppkey").alias("id"), F.lit("belongsTo").alias("type"), _id("s", "s_suppkey").alias("source_id"), nation(n).alias("target_id"), k.alias("ord"))
    none = F.lit(None)
    op = lambda rows, place, kind, target: rows.select((k * 10 + place).alias("seq"), F.lit(kind).alias("kind"), F.concat(F.lit("x"), _s("s_suppkey")).alias("id"), none.cast("string").alias("state"), none.cast("long").alias("expected_revision"), F.lit("belongsTo").alias("type"), _id("s", "s_suppkey").alias("source_id"), target.alias("target_id"))
    old, new = nation(n), nation((n + 1) % 25)
    first = op(s.where(k % 5 != 0) if faults else s, 0, "remove_edge", old)
    ops = first.unionByName(op(s, 2, "create_edge", new))
    if faults:
        ops = ops.unionByName(op(s.where(k % 7 == 0), 1, "remove_edge", old))
    nodes = spark.createDataFrame([], "id string, revision long, state string")
    return store.commit(nodes, edges, ops)


@query("SELECT 10 * s_suppkey + 1 AS seq, 'x' || s_suppkey AS id, 'not found' AS error FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 = 0 UNION ALL SELECT 10 * s_suppkey + 2, 'x' || s_suppkey, 'cardinality' FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 7 <> 0")
def transaction_errors(spark, sf):
    return _moved(spark, sf, True)["errors"]


@query("SELECT 'x' || s_suppkey AS id, 'belongsTo' AS type, 's' || s_suppkey AS source_id, 'n' || ((s_nationkey + 1) % 25) AS target_id FROM supplier")
def transaction_edges(spark, sf):
    return _moved(spark, sf, False)["edges"].drop("ord")


@query(GRAPH + "SELECT 1 AS step, 'EdgeRemoved' AS kind, id FROM edges WHERE source_id LIKE 's%' OR target_id LIKE 's%' OR id LIKE '%7' UNION ALL SELECT 2, 'NodeRetired', id FROM nodes WHERE type = 'Service'")
def rollback_run_events(spark, sf):
    nodes, edges = _both(spark, sf)
    nodes = nodes.withColumn("run_id", F.when(F.col("type") == "Service", "r1").otherwise("r0"))
    edges = edges.withColumn("run_id", F.when(F.col("id").endswith("7"), "r1").otherwise("r0"))
    return store.rolled_back(nodes, edges, "r1")[2]


@query("WITH log AS (SELECT user_id AS entity_id, CASE WHEN user_id % 3 = 0 THEN 'Relationship:consumes' ELSE 'Service' END AS entity_type, ts, event_id AS seq, CASE WHEN event_type <> 'error' THEN event_type END AS state FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, seq DESC) AS k FROM log WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') SELECT entity_id, 'consumes' AS type, state FROM r WHERE k = 1 AND state IS NOT NULL AND entity_type LIKE 'Rel%'")
def edges_at_time(spark, sf):
    log = star.log(spark, sf).withColumn("entity_type", F.when(F.col("entity_id") % 3 == 0, "Relationship:consumes").otherwise("Service"))
    return store.graph_at(log, "2024-01-10 00:00:00")[1].select("entity_id", "type", "state")


# --- gates of edges ------------------------------------------------------------------------------------------------

_EMIT = """WITH n AS (SELECT 'p' || p_partkey AS id, CASE p_size % 5 WHEN 0 THEN 'Decision' WHEN 1 THEN 'Rule' WHEN 2 THEN 'Event' WHEN 3 THEN 'OrchestrationStep' ELSE 'Service' END AS type, p_size > 10 AS ok FROM part),
e AS (SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, CASE l_linenumber WHEN 1 THEN 'evaluates' WHEN 2 THEN 'consumes' WHEN 3 THEN 'invokes' WHEN 4 THEN 'fulfils' WHEN 5 THEN 'dependsOn' WHEN 6 THEN 'emits' ELSE 'produces' END AS type, 'p' || l_partkey AS source_id, 'p' || (l_orderkey % 300) AS target_id, l_quantity / 50 AS confidence FROM lineitem),
j AS (SELECT e.*, a.type AS st, b.type AS tt, coalesce(a.ok AND b.ok, FALSE) AS inside FROM e LEFT JOIN n a ON a.id = source_id LEFT JOIN n b ON b.id = target_id),
g AS (SELECT *, CASE WHEN type IN ('consumes', 'invokes', 'emits') AND (coalesce(st IN ('Event', 'OrchestrationStep'), FALSE) OR coalesce(tt IN ('Event', 'OrchestrationStep'), FALSE)) THEN 'behavioural' WHEN type IN ('evaluates', 'consumes', 'produces') AND (coalesce(st = 'Decision', FALSE) OR coalesce(tt = 'Decision', FALSE)) THEN 'decision' WHEN type = 'fulfils' THEN 'functional' ELSE 'generic' END AS gate,
  CASE type WHEN 'evaluates' THEN st = 'Decision' AND tt = 'Rule' WHEN 'consumes' THEN st IN ('Decision', 'Service') AND tt = 'Event' WHEN 'invokes' THEN st = 'OrchestrationStep' AND tt = 'Decision' WHEN 'fulfils' THEN FALSE WHEN 'produces' THEN st = 'Decision' AND tt = 'Event' ELSE TRUE END AS fits FROM j),
r AS (SELECT *, CASE WHEN NOT inside THEN 'ends' WHEN gate <> 'generic' AND NOT fits THEN 'types' WHEN confidence < 0.5 THEN 'confidence' END AS reason FROM g)
SELECT id, gate, CASE WHEN reason IS NULL THEN 'emitted' WHEN gate <> 'generic' AND reason IN ('ends', 'types') THEN 'quarantined' ELSE 'excluded' END AS status, reason FROM r"""


def _case(column, values: list[str], other: str, first: int = 0):
    out = F.lit(other)
    for i, v in enumerate(values, first):
        out = F.when(column == i, v).otherwise(out)
    return out


@query(_EMIT)
def edge_emit_gates(spark, sf):
    entities = star.table(spark, sf, "part").select(_id("p", "p_partkey").alias("id"), _case(F.col("p_size") % 5, ["Decision", "Rule", "Event", "OrchestrationStep"], "Service").alias("type"), F.when(F.col("p_size") > 10, "emitted").otherwise("excluded").alias("status"))
    kind = _case(F.col("l_linenumber"), ["evaluates", "consumes", "invokes", "fulfils", "dependsOn", "emits"], "produces", 1)
    edges = star.table(spark, sf, "lineitem").select(F.concat(F.lit("l"), _s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("id"), kind.alias("type"), _id("p", "l_partkey").alias("source_id"), F.concat(F.lit("p"), (F.col("l_orderkey") % 300).cast("string")).alias("target_id"), (F.col("l_quantity") / 50).alias("confidence"))
    return gates.edge_emit_gate(edges, entities).select("id", "gate", "status", "reason")


@query(_LINKS + "SELECT source_id, arg_min(l.id, ord) AS id FROM links l WHERE type = 'belongsTo' AND target_id = 'gone' AND source_id IN (SELECT id FROM nodes) GROUP BY source_id")
def relinked_edges(spark, sf):
    """Edges that dangled, judged again once their target is known."""
    held = _gated(spark, sf).where("reason = 'dangling'")
    order = F.split("id", "-")
    held = held.select("id", "type", "source_id", "target_id", (F.substring(order[0], 2, 20).cast("long") * 100 + order[1].cast("long")).alias("ord"))
    nodes = star.nodes(spark, sf).select("id", "type").unionByName(spark.createDataFrame([("gone", "BoundedContext")], "id string, type string"))
    return gates.relinked(held, nodes)[0].select("source_id", "id")


@query("SELECT CASE WHEN l_linenumber <= 2 THEN 'skipped' WHEN l_partkey % 11 = 0 THEN 'quarantined' ELSE 'loaded' END AS status, l_linenumber > 2 AND l_partkey % 11 = 0 AS retriable, count(*) AS n FROM lineitem GROUP BY ALL")
def load_run_statuses(spark, sf):
    line = star.table(spark, sf, "lineitem")
    entry = F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber"))
    edges = line.select(F.lit("r1").alias("run_id"), entry.alias("entry_id"), entry.alias("id"), F.lit("emits").alias("type"), F.lit("n1").alias("source_id"), F.when(F.col("l_partkey") % 11 == 0, "gone").otherwise("n2").alias("target_id"), F.col("l_orderkey").alias("ord"), "l_linenumber")
    done = edges.where("l_linenumber <= 2").select("run_id", "entry_id")
    return gates.load(edges, star.nodes(spark, sf), done).groupBy("status", "retriable").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, round(avg(p_size / 50.0), 4) AS average FROM part WHERE p_size / 50.0 >= 0.5")
def average_confidence(spark, sf):
    rows = star.table(spark, sf, "part").withColumn("confidence", F.col("p_size") / 50)
    return gates.average_confidence(gates.emit_gate(rows))


# --- graph --------------------------------------------------------------------------------------------------------------


@query("SELECT 'p' || p_partkey AS id, count(*) OVER (PARTITION BY p_partkey // 400 ORDER BY p_partkey DESC) - 1 AS descendants FROM part")
def descendants_of_deep_chains(spark, sf):
    """Chains of up to 400 parts, each the child of the one before."""
    k = F.col("p_partkey")
    parent = F.when(k % 400 > 0, k - 1)
    rows = star.table(spark, sf, "part").select(k.alias("id"), parent.alias("parent"))
    first = rows.agg(F.min("id")).first()[0]
    rows = rows.withColumn("parent", F.when(F.col("id") > first, F.col("parent")))
    return graph.descendant_counts(graph.forest(rows)).select(_id("p", "id").alias("id"), "descendants")


@query(_CROSS)
def contracted_graph(spark, sf):
    nodes, edges = _both(spark, sf)
    groups = views.member_contexts(nodes, edges).select("id", F.col("context").alias("group"))
    return graph.contracted(edges.where("type = 'consumes'"), groups).select("source", "target", "type", F.col("n").alias("strength"))


@query("SELECT 'c' || o_custkey AS source_id, 's' || l_suppkey AS target_id, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")
def edge_multiplicity(spark, sf):
    orders, lines = star.table(spark, sf, "orders"), star.table(spark, sf, "lineitem")
    return graph.multiplicity(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(_id("c", "o_custkey").alias("source_id"), _id("s", "l_suppkey").alias("target_id")))


_ONCE = GRAPH.replace(" AS (", " AS MATERIALIZED (", 1).replace("edges AS (", "edges AS MATERIALIZED (", 1)


@query(_ONCE + ", b AS MATERIALIZED (SELECT * FROM edges WHERE type = 'belongsTo' AND target_id = 'n7') SELECT a.source_id AS n0, a.id AS e0, a.target_id AS n1, b.id AS e1, b.target_id AS n2 FROM edges a JOIN b ON b.source_id = a.target_id WHERE a.type = 'consumes'")
def pattern_match(spark, sf):
    """A path: concepts that consume services of one context."""
    path = patterns.chain(["DomainConcept", "consumes", "Service", "belongsTo", "BoundedContext"])
    one = patterns.Pattern(path.nodes | {"n2": patterns.Node("BoundedContext", "id = 'n7'")}, path.hops)
    return patterns.matches(*_both(spark, sf), one)


@query(_ONCE + ", b AS MATERIALIZED (SELECT * FROM edges WHERE type = 'belongsTo') SELECT r.source_id AS context, r.target_id AS domain, c.source_id AS concept, s.source_id AS service FROM b r JOIN b c ON c.target_id = r.source_id JOIN nodes cn ON cn.id = c.source_id JOIN b s ON s.target_id = r.source_id JOIN nodes sn ON sn.id = s.source_id WHERE r.target_id LIKE 'r%' AND cn.type = 'DomainConcept' AND cn.segment = 'BUILDING' AND sn.type = 'Service' AND sn.lifecycle_status = 'active'")
def pattern_star(spark, sf):
    """A star: contexts with their domain, a concept of one segment and an active service."""
    nodes = {"context": patterns.Node("BoundedContext"), "domain": patterns.Node("Subdomain"), "concept": patterns.Node("DomainConcept", "segment = 'BUILDING'"), "service": patterns.Node("Service", "lifecycle_status = 'active'")}
    hops = [patterns.Hop("context", "domain", ("belongsTo",)), patterns.Hop("concept", "context", ("belongsTo",)), patterns.Hop("service", "context", ("belongsTo",))]
    return patterns.matches(*_both(spark, sf), patterns.Pattern(nodes, hops)).select(*nodes)


@query(_ONCE + ", b AS MATERIALIZED (SELECT * FROM edges WHERE type = 'belongsTo') SELECT e.source_id AS concept, e.target_id AS service, c.target_id AS context, e.id AS consumes FROM edges e JOIN b c ON c.source_id = e.source_id JOIN b s ON s.source_id = e.target_id AND s.target_id = c.target_id WHERE e.type = 'consumes'")
def pattern_triangle(spark, sf):
    """A triangle: concepts that consume a service of their own context."""
    nodes = {"concept": patterns.Node("DomainConcept"), "service": patterns.Node("Service"), "context": patterns.Node("BoundedContext")}
    hops = [patterns.Hop("concept", "service", ("consumes",), "consumes"), patterns.Hop("concept", "context", ("belongsTo",)), patterns.Hop("service", "context", ("belongsTo",))]
    return patterns.matches(*_both(spark, sf), patterns.Pattern(nodes, hops)).select(*nodes, "consumes")


@query(_ONCE + ", w2 AS (SELECT DISTINCT a.source_id AS s, b.target_id AS t FROM edges a JOIN edges b ON b.source_id = a.target_id WHERE a.source_id LIKE 'c%'), w3 AS (SELECT DISTINCT w2.s, e.target_id AS t FROM w2 JOIN edges e ON e.source_id = w2.t), w AS (SELECT s, t, min(k) AS steps FROM (SELECT s, t, 2 AS k FROM w2 UNION ALL SELECT s, t, 3 FROM w3) x GROUP BY ALL) SELECT w.s AS concept, w.t AS domain, w.steps, e.source_id AS context FROM w JOIN edges e ON e.target_id = w.t AND e.type = 'belongsTo' JOIN nodes n ON n.id = w.s WHERE w.t LIKE 'r%' AND n.segment = 'MACHINERY' AND n.lifecycle_status = 'draft' AND e.source_id LIKE 'n%'")
def pattern_walks(spark, sf):
    """Walks of two or three edges of any type from some concepts to domains, and the domains' contexts."""
    nodes = {"concept": patterns.Node("DomainConcept", "segment = 'MACHINERY' and lifecycle_status = 'draft'"), "domain": patterns.Node("Subdomain"), "context": patterns.Node("BoundedContext")}
    hops = [patterns.Hop("concept", "domain", None, "steps", 2, 3), patterns.Hop("context", "domain", ("belongsTo",))]
    return patterns.matches(*_both(spark, sf), patterns.Pattern(nodes, hops)).select(*nodes, "steps")


@query(GRAPH + "SELECT id, type, name FROM nodes WHERE type IN ('Service', 'Subdomain') OR id IN ('n1', 'n2')")
def subgraph_merge(spark, sf):
    nodes, edges = _both(spark, sf)
    a = (nodes.where("type = 'Service' or id = 'n1'"), edges.where("source_id = 's1'"), False)
    b = (nodes.where("type = 'Subdomain' or id in ('n1', 'n2')"), edges.where("source_id in ('s1', 'n1')"), True)
    return graph.merged_subgraphs(a, b)[0].select("id", "type", "name")


# --- dependencies -------------------------------------------------------------------------------------------------

_RUNS = """WITH o AS (SELECT o_orderkey AS id, {'c': o_custkey, 'y': year(o_orderdate)} AS who, o_orderstatus AS s, row_number() OVER w AS k, coalesce(lag(o_orderstatus) OVER w = o_orderstatus, false) AS same FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT *, count_if(NOT same) OVER (PARTITION BY who ORDER BY k) AS run, count(*) OVER (PARTITION BY who) AS n FROM o) """


def _order_edges(spark, sf):
    """Each order depends on its customer's next one of the year, and on the one before if both have the same status."""
    w = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    lined = star.table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), F.lead("o_orderkey").over(w).alias("next"), (F.lead("o_orderstatus").over(w) == F.col("o_orderstatus")).alias("same"))
    on = lined.where("next is not null").select("source_id", F.col("next").alias("target_id"), "same")
    return on.select("source_id", "target_id").unionByName(on.where("same").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


@query(_RUNS + "SELECT id, max(id) OVER (PARTITION BY who, run) AS component, count(*) OVER (PARTITION BY who, run) AS size, CAST(max(run) OVER (PARTITION BY who) - run AS INT) AS layer FROM r WHERE n > 1")
def dependency_layers(spark, sf):
    """Runs of orders of one status are circles, and a customer's runs in a year a chain."""
    return dependencies.members(_order_edges(spark, sf))[0]


@query("WITH f AS (SELECT l_orderkey AS id, l_returnflag AS flag, min({'p': l_partkey, 's': l_suppkey, 'd': l_shipdate}) AS first FROM lineitem GROUP BY ALL) SELECT id, string_agg(flag, ',' ORDER BY first) AS types FROM f GROUP BY id")
def target_types(spark, sf):
    """Return flags of each order's lines, each once, in the order of their first line."""
    lines = star.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag"))).alias("lines"))
    return lines.select("id", F.array_join(tx.target_types(F.transform("lines", lambda x: x["l_returnflag"])), ",").alias("types"))


# --- vectors ------------------------------------------------------------------------------------------------------------


def _vectors(spark, sf, **how):
    folder, rows = new_path(spark, "vector-index"), star.table(spark, sf, "embeddings")
    vectorindex.build(rows, folder, "vec_id", "embedding", cells=16)
    found = vectorindex.VectorIndex(spark, folder).search(rows.where("vec_id % 20 = 0"), 10, "vec_id", "embedding", **how)
    return found.select("query", F.col("id").alias("vec_id"), "place")


@query("WITH u AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), r AS (SELECT q.vec_id AS query, u.vec_id, round(list_cosine_similarity(q.e, u.e), 9) AS score FROM u q, u WHERE q.vec_id % 20 = 0) SELECT query, vec_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INT) AS place FROM r QUALIFY place <= 10")
def vector_index_exact(spark, sf):
    """The ten nearest rows of every twentieth vector, in the index's exact mode."""
    return _vectors(spark, sf, exact=True)


@query()
def vector_index_top(spark, sf):
    """The same by cells and codes; a test holds its recall against the exact mode."""
    return _vectors(spark, sf, probes=12)


# --- schemas --------------------------------------------------------------------------------------------------------

_CUSTOMER = {
    "$defs": {"place": {"type": "object", "required": ["key"], "properties": {"key": {"type": "integer", "maximum": 21}}, "additionalProperties": False}},
    "type": "object",
    "required": ["name", "segment"],
    "properties": {"name": {"type": "string", "pattern": "[0-8]$"}, "segment": {"enum": ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE"]}, "balance": {"anyOf": [{"minimum": 0}, {"maximum": -500}]}, "nation": {"$ref": "#/$defs/place"}},
    "if": {"properties": {"segment": {"const": "BUILDING"}}},
    "then": {"properties": {"marks": {"maxItems": 1, "items": {"not": {"const": 7}}}}},
}


@query(
    """SELECT c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 3 THEN '$.segment: required' WHEN right(c_name, 1) = '9' THEN '$.name: pattern' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE') THEN '$.segment: enum'
WHEN c_acctbal < 0 AND c_acctbal > -500 THEN '$.balance: anyOf' WHEN c_nationkey = 4 THEN '$.nation.key: required' WHEN c_nationkey > 21 THEN '$.nation.key: maximum' WHEN c_nationkey = 5 THEN '$.nation.name: additionalProperties'
WHEN c_mktsegment = 'BUILDING' AND c_nationkey >= 10 THEN '$.marks: maxItems' WHEN c_mktsegment = 'BUILDING' AND c_nationkey = 7 THEN '$.marks[0]: not' END AS breach,
CASE WHEN c_mktsegment = 'MACHINERY' AND c_nationkey = 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS completeness FROM customer"""
)
def schema_breaches(spark, sf):
    """The first rule that each customer's data break: nested objects, references, alternatives, conditions and lists."""
    k, odd = F.col("c_nationkey"), (F.col("c_mktsegment") == "MACHINERY") & (F.col("c_nationkey") == 3)
    nation = F.struct(F.when(k != 4, k).alias("key"), F.when(k == 5, "five").alias("name"))
    marks = F.array_compact(F.array(k, F.when(k >= 10, F.lit(1))))
    data = F.parse_json(F.to_json(F.struct(F.col("c_name").alias("name"), F.when(~odd, F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").alias("balance"), nation.alias("nation"), marks.alias("marks"))))
    rows = star.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), data.alias("data"))
    return rows.select("id", jsonschema.breach(_CUSTOMER, F.col("data")).alias("breach"), jsonschema.completeness(_CUSTOMER["required"], F.col("data")).alias("completeness"))


# --- keyword search ---------------------------------------------------------------------------------------------------


@query(
    """WITH d AS MATERIALIZED (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
s AS (SELECT count(*) AS n, avg(len(ws)) AS average FROM d), q AS MATERIALIZED (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM benchmark),
p AS MATERIALIZED (SELECT doc, len, word, count(*) AS tf FROM (SELECT doc, len(ws) AS len, unnest(ws) AS word FROM d) x WHERE word IN (SELECT word FROM q) GROUP BY ALL),
f AS MATERIALIZED (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY word, n),
r AS (SELECT query, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / average))), 6) AS score FROM q JOIN f USING (word) JOIN p USING (word), s GROUP BY query, doc)
SELECT query, doc, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS place FROM r QUALIFY place <= 10"""
)
def keyword_bm25(spark, sf):
    """The ten best documents for the text of every benchmark item."""
    folder = new_path(spark, "text-index")
    textindex.build(star.table(spark, sf, "documents"), folder, "doc_id", "text", buckets=16)
    found = textindex.TextIndex(spark, folder).search(star.table(spark, sf, "benchmark"), 10, "item_id", "text")
    return found.select("query", "doc", "place")


# --- access -----------------------------------------------------------------------------------------------------------

_ACCESS = """WITH RECURSIVE members AS (SELECT 'u' || c_custkey AS member, 'segment ' || c_mktsegment AS role FROM customer UNION ALL SELECT DISTINCT 'segment ' || c_mktsegment, 'staff' FROM customer UNION ALL SELECT 'staff', 'everyone' UNION ALL SELECT 'everyone', 'staff'),
held AS (SELECT 'u' || c_custkey AS who, 'u' || c_custkey AS principal, 0 AS distance FROM customer UNION SELECT who, role, distance + 1 FROM held JOIN members ON member = principal WHERE distance < 4),
near AS (SELECT who, principal, min(distance) AS distance FROM held GROUP BY ALL),
grants AS (SELECT 'u' || c_custkey AS principal, 'O' AS kind, 'n' || c_nationkey AS scope, CASE WHEN c_acctbal > 9500 THEN 'deny' ELSE 'allow' END AS effect FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 'u' || c_custkey, '*', '*', 'deny' FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'u' || c_custkey, 'P', '*', 'allow' FROM customer WHERE c_acctbal < 1000
UNION ALL VALUES ('segment BUILDING', '*', '*', 'deny'), ('segment MACHINERY', 'O', '*', 'allow'), ('segment MACHINERY', '*', 'n3', 'deny'), ('staff', 'F', '*', 'allow'), ('staff', 'F', 'n4', 'deny'), ('everyone', 'F', 'n4', 'allow'), ('everyone', 'P', '*', 'allow'), ('everyone', 'P', '*', 'deny')),
asked AS (SELECT o_orderkey AS id, 'u' || o_custkey AS who, o_orderstatus AS kind, 'n' || c_nationkey AS scope FROM orders JOIN customer ON c_custkey = o_custkey),
fit AS (SELECT a.id, g.effect, n.distance, (g.kind = '*')::INT + (g.scope = '*')::INT AS wild FROM asked a JOIN near n ON n.who = a.who JOIN grants g ON g.principal = n.principal AND g.kind IN (a.kind, '*') AND g.scope IN (a.scope, '*')),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, wild, effect = 'allow') AS k FROM fit) """


@query(_ACCESS + "SELECT asked.id, coalesce(effect = 'allow', false) AS allowed, CASE WHEN distance IS NULL THEN 'none' WHEN distance > 0 THEN 'inherited' WHEN wild > 0 THEN 'wildcard' ELSE 'explicit' END AS rule FROM asked LEFT JOIN best ON best.id = asked.id AND k = 1")
def access_decisions(spark, sf):
    """Whether every order may be read by its customer, who has own grants and those of roles within roles, in a circle at the top."""
    c, o = star.table(spark, sf, "customer"), star.table(spark, sf, "orders")
    user, segment, scope = _id("u", "c_custkey"), F.concat(F.lit("segment "), F.col("c_mktsegment")), _id("n", "c_nationkey")
    pair = lambda a, b: (a.alias("member"), b.alias("role"))
    members = c.select(*pair(user, segment)).unionByName(c.select(*pair(segment, F.lit("staff"))).distinct()).unionByName(spark.createDataFrame([("staff", "everyone"), ("everyone", "staff")], "member string, role string"))
    grant = lambda rows, kind, where, effect: rows.select(user.alias("principal"), F.lit("read").alias("action"), F.lit(kind).alias("kind"), where.alias("scope"), effect.alias("effect"))
    grants = grant(c.where("c_acctbal > 9000"), "O", scope, F.when(F.col("c_acctbal") > 9500, "deny").otherwise("allow")).unionByName(grant(c.where("c_acctbal < 0"), "*", F.lit("*"), F.lit("deny"))).unionByName(grant(c.where("c_acctbal < 1000"), "P", F.lit("*"), F.lit("allow")))
    given = [("segment BUILDING", "*", "*", "deny"), ("segment MACHINERY", "O", "*", "allow"), ("segment MACHINERY", "*", "n3", "deny"), ("staff", "F", "*", "allow"), ("staff", "F", "n4", "deny"), ("everyone", "F", "n4", "allow"), ("everyone", "P", "*", "allow"), ("everyone", "P", "*", "deny")]
    grants = grants.unionByName(spark.createDataFrame([(p, "read", k, s, e) for p, k, s, e in given], grants.schema))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), user.alias("user"), F.col("o_orderstatus").alias("kind"), scope.alias("scope"))
    return service.decided(rows, grants, service.held_roles(members)).select("id", "allowed", "rule")


# --- views kept up to date ------------------------------------------------------------------------------------


def _upkept(spark, sf, view):
    """Three batches: all nodes and edges but some; then a third of the suppliers moves to the next nation, some concepts go and
    others turn to capabilities; then the moved ones' edges of one kind go again, and mappings come and go."""
    nodes, edges = _both(spark, sf)
    edges = settled(edges, "edges")  # several batches take from them
    nodes, kept = nodes.select("id", "type", "name"), upkeep.Upkeep(spark, new_path(spark, "upkeep"), buckets=8, views=(view,))
    put = lambda df, m: df.withColumn("m", F.lit(m))
    k = F.substring("id", 2, 20).cast("int")
    concept, service = F.col("type") == "DomainConcept", F.col("type") == "Service"
    serves = edges.where("type = 'consumes'").select(F.concat(F.lit("f-"), "id").alias("id"), F.when(F.crc32("id") % 2 == 0, "fulfils").otherwise("implements").alias("type"), F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    kept.apply(1, put(nodes.where(~(concept & (k % 11 == 0))), 1), put(edges.unionByName(serves.where("type = 'fulfils'")), 1))
    moving = star.table(spark, sf, "supplier").where("s_suppkey % 3 = 0")
    at = lambda step: F.concat(F.lit("n"), ((F.col("s_nationkey") + step) % 25).cast("string"))
    own = lambda step: moving.select(F.concat(F.lit("e-"), _id("s", "s_suppkey"), F.lit("-"), at(step)).alias("id"), F.lit("belongsTo").alias("type"), _id("s", "s_suppkey").alias("source_id"), at(step).alias("target_id"))
    turned = nodes.where(concept & (k % 11 != 0) & (k % 5 == 0))
    gone = nodes.where(concept & (k % 11 != 0) & (k % 7 == 0))
    changed = put(nodes.where(concept & (k % 11 == 0)), 1).unionByName(put(turned, -1)).unionByName(put(turned.withColumn("type", F.lit("BusinessCapability")), 1))
    kept.apply(2, changed, put(own(0), -1).unionByName(put(own(1), 1)).unionByName(put(serves.where("type = 'implements'"), 1)))
    last = put(gone.where(k % 5 != 0), -1).unionByName(put(gone.where(k % 5 == 0).withColumn("type", F.lit("BusinessCapability")), -1))
    few = serves.where(F.substring("source_id", 2, 20).cast("int") % 3 == 0)
    said = star.table(spark, sf, "customer").where("c_custkey % 4 = 0").select(_id("m", "c_custkey").alias("id"), _id("c", "c_custkey").alias("target_id"), F.when(F.col("c_custkey") % 3 == 0, "full").otherwise("partial").alias("coverage"))
    kept.vacuum(1)  # versions that nobody reads are as large as the tables
    kept.apply(3, last, put(few, -1), put(said, 1))
    kept.vacuum(1)
    kept.apply(4, mappings=put(said.where("coverage = 'full' and target_id like '%4'"), -1))
    kept.apply(3, nodes=put(nodes, -1))  # a repeated batch changes nothing
    return kept


_UPKEPT = _ONCE + """, n2 AS MATERIALIZED (SELECT id, name, k, CASE WHEN type = 'DomainConcept' AND k % 5 = 0 AND k % 11 <> 0 THEN 'BusinessCapability' ELSE type END AS type FROM (SELECT *, TRY_CAST(substr(id, 2) AS INT) AS k FROM nodes) x WHERE NOT (type = 'DomainConcept' AND k % 11 <> 0 AND k % 7 = 0)),
b2 AS MATERIALIZED (SELECT source_id, CASE WHEN source_id LIKE 's%' AND CAST(substr(source_id, 2) AS INT) % 3 = 0 THEN 'n' || ((CAST(substr(target_id, 2) AS INT) + 1) % 25) ELSE target_id END AS target_id FROM edges WHERE type = 'belongsTo'),
f2 AS MATERIALIZED (SELECT 'f-' || id AS id, target_id AS source_id, source_id AS target_id FROM edges WHERE type = 'consumes' AND CAST(substr(target_id, 2) AS INT) % 3 <> 0),
"""


@query(_UPKEPT + "m2 AS (SELECT DISTINCT b2.source_id, b2.target_id, n2.type FROM b2 JOIN n2 ON n2.id = b2.source_id) SELECT n2.id, CAST(count_if(m2.type = 'DomainConcept') AS BIGINT) AS concepts, CAST(count_if(m2.type = 'Service') AS BIGINT) AS services FROM n2 LEFT JOIN m2 ON m2.target_id = n2.id WHERE n2.type = 'BoundedContext' GROUP BY n2.id")
def upkept_contexts(spark, sf):
    """Members of contexts after four batches of changes, as a recomputation has them."""
    return _upkept(spark, sf, "contexts").context_counts()


@query(_UPKEPT + "m2 AS MATERIALIZED (SELECT b2.source_id AS member, max(b2.target_id) AS context FROM b2 WHERE b2.target_id LIKE 'n%' GROUP BY 1), kinds AS (SELECT id, type, source_id, target_id FROM edges WHERE type = 'consumes') SELECT a.context AS source, b.context AS target, k.type, count(DISTINCT k.id) AS strength FROM kinds k JOIN m2 a ON a.member = k.source_id JOIN m2 b ON b.member = k.target_id WHERE a.context <> b.context GROUP BY ALL")
def upkept_links(spark, sf):
    """Edges between contexts after the same batches."""
    return _upkept(spark, sf, "links").cross_context().where("type = 'consumes'")


@query(
    _UPKEPT
    + "i2 AS (SELECT target_id AS id, count(*) AS incoming FROM (SELECT target_id FROM f2 UNION ALL SELECT target_id FROM b2 UNION ALL SELECT target_id FROM edges WHERE type = 'consumes') x GROUP BY 1), m2 AS (SELECT 'c' || c_custkey AS id, c_custkey % 3 = 0 AS full FROM customer WHERE c_custkey % 4 = 0 AND NOT (c_custkey % 3 = 0 AND c_custkey % 10 = 4)) SELECT n2.id, coalesce(incoming, 0) AS incoming, coalesce(m2.full, false) AS any_full, m2.id IS NOT NULL AS any_mapped FROM n2 LEFT JOIN i2 USING (id) LEFT JOIN m2 ON m2.id = n2.id WHERE n2.type IN ('DomainConcept', 'BusinessCapability')"
)
def upkept_coverage(spark, sf):
    """Coverage of elements after the same batches; kinds of edges are held against a recomputation in the tests."""
    return _upkept(spark, sf, "elements").coverage().select("id", "incoming", "any_full", "any_mapped")


# --- views as a whole ---------------------------------------------------------------------------------------------------------


@query("SELECT 'n' || c_nationkey AS context, 'c' || c_custkey AS id, 'DomainConcept' AS type, c_name AS name FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'Service', s_name FROM supplier")
def context_members(spark, sf):
    return views.context_detail(*_both(spark, sf))[0]


@query("WITH " + _TREE + "SELECT t.id, t.parent, d.depth, c.descendants FROM tree t JOIN (SELECT id, max(distance) AS depth FROM closed GROUP BY id) d USING (id) JOIN (SELECT ancestor AS id, count(*) - 1 AS descendants FROM closed GROUP BY ancestor) c USING (id)")
def capability_map_view(spark, sf):
    """Types, brands and parts as capabilities that state their parent by name, in other letters."""
    part = star.table(spark, sf, "part")
    cap = lambda rows, i, parent: rows.select(i.alias("id"), i.alias("name"), parent.alias("parent_name"))
    none = F.lit(None).cast("string")
    brand = part.groupBy("p_brand").agg(F.min("p_type").alias("t"))
    rows = cap(part.select("p_type").distinct(), F.concat(F.lit("t"), "p_type"), none)
    rows = rows.unionByName(cap(brand, F.concat(F.lit("b"), "p_brand"), F.upper(F.concat(F.lit("t"), "t"))))
    rows = rows.unionByName(cap(part, _id("p", "p_partkey"), F.concat(F.lit(" b"), "p_brand")))
    nodes = rows.withColumn("type", F.lit("BusinessCapability"))
    edges = spark.createDataFrame([], "id string, type string, source_id string, target_id string")
    return views.capability_map(nodes, edges).select("id", "parent", "depth", "descendants")


_ARCH = "n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), placed AS (SELECT * FROM s WHERE k % 3 = 0) "


def _architecture(spark, sf):
    region, nation, supplier = (star.table(spark, sf, t) for t in ("region", "nation", "supplier"))
    kind = lambda t: F.lit(t).alias("type")
    nodes = region.select(_id("r", "r_regionkey").alias("id"), kind("ReferenceCapability"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_name"))
    regions = region.select("r_regionkey", F.lower("r_name").alias("_r"))
    nodes = nodes.unionByName(nation.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(_id("n", "n_nationkey").alias("id"), kind("ReferenceCapability"), F.col("n_name").alias("name"), F.col("_r").alias("parent_name")))
    nodes = nodes.unionByName(supplier.select(_id("s", "s_suppkey").alias("id"), kind("BusinessCapability"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("parent_name")))
    k = F.col("s_suppkey")
    verdicts = supplier.where(k % 3 < 2).select(_id("v", "s_suppkey").alias("id"), _id("s", "s_suppkey").alias("subject"), F.when(k % 3 == 0, "placed").otherwise("rejected").alias("disposition"), _id("n", "s_nationkey").alias("assigned_parent"), F.when(k % 2 == 0, "duplicate").alias("rejection_reason"), F.lit(0.9).alias("confidence"))
    return views.business_architecture(nodes, verdicts, 0.5)


@query("WITH " + _ARCH + "SELECT 'r' || r_regionkey AS id, NULL AS parent, 0 AS depth, (SELECT count(*) FROM n WHERE r = r_regionkey) + (SELECT count(*) FROM placed JOIN n ON placed.n = n.k WHERE n.r = r_regionkey) AS descendants FROM region UNION ALL SELECT 'n' || k, 'r' || r, 1, (SELECT count(*) FROM placed WHERE placed.n = n.k) FROM n UNION ALL SELECT 's' || k, 'n' || n, 2, 0 FROM placed")
def business_architecture_tree(spark, sf):
    return _architecture(spark, sf)["tree"].select("id", "parent", "depth", "descendants")


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'duplicate' ELSE 'unspecified' END AS reason, count(*) AS n FROM supplier WHERE s_suppkey % 3 = 1 GROUP BY 1")
def business_architecture_rejected(spark, sf):
    return _architecture(spark, sf)["rejected"]


@query("SELECT count(*) AS n, least(count(*), 50) AS named FROM supplier WHERE s_suppkey % 3 = 2")
def business_architecture_unclassified(spark, sf):
    return _architecture(spark, sf)["unclassified_summary"].select("n", F.size("names").cast("long").alias("named"))


def _market(spark, sf):
    """Brands as capabilities in two domains, suppliers as products of their nation that claim what it covers."""
    brands = star.brands(spark, sf).select("id", F.lit("BusinessCapability").alias("type"), "name", F.when(F.length("name") % 2 == 0, "Even").otherwise("Odd").alias("domain"), F.lit(None).cast("string").alias("vendor"), F.lit(None).cast("array<string>").alias("claims"))
    products = star.table(spark, sf, "supplier").select(_id("s", "s_suppkey").alias("id"), F.lit("VendorProduct").alias("type"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("domain"), _id("Nation ", "s_nationkey").alias("vendor"), F.array(_id("cap-", "s_nationkey")).alias("claims"))
    return brands.unionByName(products)


@query(COVER + ", cols AS (SELECT 's' || s_suppkey AS c, 'cap-' || s_nationkey AS cap FROM supplier WHERE s_nationkey = 3) SELECT b.id AS \"row\", c AS \"column\", CASE WHEN m.coverage = 'full' THEN 'covered' WHEN m.coverage = 'partial' THEN 'partial' ELSE 'uncovered' END AS status, m.percentage, m.id AS first_mapping FROM brands b CROSS JOIN cols LEFT JOIN mappings m ON m.target_id = b.id AND m.capability = cols.cap")
def vendor_coverage_matrix(spark, sf):
    """Every brand by every product of one vendor, with the cells that nothing covers."""
    return views.coverage_view(_market(spark, sf), star.brand_edges(spark, sf), star.mappings(spark, sf), vendor="nation 3")["cells"].drop("gaps")


@query(COVER + ", e AS (SELECT target_id, count_if(type = 'fulfils') AS f, count_if(type = 'implements') AS t, count(*) AS n FROM thin_edges GROUP BY 1), m AS (SELECT target_id, bool_or(coverage <> 'none') AS mapped FROM mappings GROUP BY 1), a AS (SELECT b.id, coalesce(n, 0) AS priority, coalesce(f, 0) > 0 OR coalesce(mapped, FALSE) AS functional, coalesce(t, 0) > 0 AS technical, CASE WHEN length(b.name) % 2 = 0 THEN 'Even' ELSE 'Odd' END AS domain FROM brands b LEFT JOIN e ON e.target_id = b.id LEFT JOIN m ON m.target_id = b.id) SELECT id, domain, priority FROM a WHERE domain = 'Odd' AND NOT (functional AND technical) UNION ALL SELECT id, domain, priority FROM a WHERE domain = 'Even' AND NOT (functional AND technical)")
def gaps_by_domain(spark, sf):
    tables = (_market(spark, sf), star.brand_edges(spark, sf, thin=True), star.mappings(spark, sf))
    both = views.gap_view(*tables, domain="odd")["gaps"].unionByName(views.gap_view(*tables, domain="EVEN")["gaps"])
    return both.select("id", "domain", "priority")


# --- classification and resolution ------------------------------------------------------------------------------------------------


@query("WITH b AS (SELECT type, id, name, CAST(floor((row_number() OVER (ORDER BY name, id) - 1) / 40) AS INT) AS batch FROM (SELECT 'p' || p_partkey AS id, p_type AS type, p_brand AS name FROM part) x) SELECT DISTINCT type, batch, name, id AS subject FROM b WHERE name IN ('Brand#11', 'Brand#3', 'Brand#23')")
def verdict_subjects(spark, sf):
    entities = _entities(spark, sf).select("id", "type", F.col("brand").alias("name"))
    batches = resolution.classification_batches(entities, spark.createDataFrame([], "subject string"))
    verdicts = batches.select("batch").distinct().withColumn("name", F.explode(F.array(F.lit("Brand#11"), F.lit("Brand#3"), F.lit("Brand#23"), F.lit("nothing"))))
    return resolution.verdict_subjects(verdicts, batches).join(entities.select(F.col("id").alias("subject"), "type"), "subject").select("type", "batch", "name", "subject")


@query("SELECT 'cls-s' || s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'new' ELSE 'old' END AS disposition FROM supplier WHERE s_suppkey % 4 = 0 OR s_suppkey % 3 > 0 AND s_suppkey % 2 = 0")
def reclassified(spark, sf):
    """Old verdicts on even suppliers, new ones on every fourth; only some subjects still live."""
    s, k = star.table(spark, sf, "supplier"), F.col("s_suppkey")
    said = lambda rows, word: rows.select(_id("cls-s", "s_suppkey").alias("id"), _id("s", "s_suppkey").alias("subject"), F.lit(word).alias("disposition"))
    live = s.where(k % 3 > 0).select(_id("s", "s_suppkey").alias("id"))
    return resolution.reclassified(said(s.where(k % 2 == 0), "old"), said(s.where(k % 4 == 0), "new"), live).select("id", "disposition")


@query("SELECT r_name AS name, string_agg(n_name, ',' ORDER BY n_name) AS children FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def spine_outline(spark, sf):
    region, nation = star.table(spark, sf, "region"), star.table(spark, sf, "nation")
    tops = region.select(F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent"))
    lower = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.lit(2).alias("level"), F.col("r_name").alias("parent"))
    return resolution.spine_outline(tops.unionByName(lower)).select("name", F.array_join("children", ",").alias("children"))


@query("WITH r AS (SELECT l_partkey AS id, l_suppkey AS other, round(l_discount * 10, 6) AS similarity, row_number() OVER (PARTITION BY l_partkey ORDER BY round(l_discount * 10, 6) DESC, l_suppkey DESC) AS k FROM lineitem) SELECT id, CASE WHEN similarity >= 0.85 THEN 'merge' WHEN similarity >= 0.6 THEN 'link' ELSE 'create' END AS action, CASE WHEN similarity >= 0.6 THEN other END AS other FROM r WHERE k = 1")
def resolution_actions(spark, sf):
    return resolution.resolution_actions(star.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("other"), F.round(F.col("l_discount") * 10, 6).alias("similarity")))


@query("WITH m AS (SELECT DISTINCT l_orderkey AS document, l_partkey // 2 AS id FROM lineitem), k AS (SELECT id, count(*) AS documents FROM m GROUP BY id HAVING count(*) > 1) SELECT document, id, documents FROM m JOIN k USING (id)")
def cross_document_relationships(spark, sf):
    line = star.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_partkey").alias("id"))
    remap = line.select("id").distinct().withColumn("survivor", F.floor(F.col("id") / 2))
    return resolution.cross_document_relationships(line, remap)


@query(
    """WITH parts AS MATERIALIZED (SELECT DISTINCT l_orderkey AS document, 'p' || l_partkey || '-' || l_suppkey AS id FROM lineitem),
flags AS MATERIALIZED (SELECT DISTINCT l_orderkey AS document, l_returnflag AS id FROM lineitem),
few AS MATERIALIZED (SELECT id FROM parts GROUP BY id HAVING count(*) BETWEEN 2 AND 100),
p AS MATERIALIZED (SELECT a.document, b.document AS other_document, count(*) AS n FROM parts a JOIN few USING (id) JOIN parts b ON b.id = a.id AND a.document < b.document GROUP BY ALL),
f AS (SELECT p.document, p.other_document, count(*) AS more FROM p JOIN flags a ON a.document = p.document JOIN flags b ON b.document = p.other_document AND b.id = a.id GROUP BY ALL)
SELECT document, other_document, n + coalesce(more, 0) AS n FROM p LEFT JOIN f USING (document, other_document)"""
)
def related_documents(spark, sf):
    """Orders that share a part of one supplier, with all parts and return flags that they share; a flag is shared by a third of all orders."""
    lines = star.table(spark, sf, "lineitem")
    part = F.concat(F.lit("p"), _s("l_partkey"), F.lit("-"), _s("l_suppkey"))
    mentions = lines.select(F.col("l_orderkey").alias("document"), F.explode(F.array(part, F.concat(F.lit("flag "), F.col("l_returnflag")))).alias("id"))
    return resolution.related_documents(mentions, spark.createDataFrame([], "id string, survivor string"))


@query("WITH n AS (SELECT 'belongsTo' AS type, lower(n_name) AS source, lower(r_name) AS target, n_nationkey AS k FROM nation JOIN region ON r_regionkey = n_regionkey), c AS (SELECT CAST(count_if(k % 5 > 0 AND k % 4 > 0) AS BIGINT) AS tp, CAST(count_if(k % 5 > 0 AND k % 4 = 0) AS BIGINT) AS fp, CAST(count_if(k % 5 = 0 AND k % 4 > 0) AS BIGINT) AS fn FROM n) SELECT kind, tp, fp, fn FROM c, (SELECT 'belongsTo' AS kind UNION ALL SELECT NULL) y")
def relation_scores(spark, sf):
    """Relations of some nations to their regions against other labels; one of an unknown end is dropped."""
    nation, region = star.table(spark, sf, "nation"), star.table(spark, sf, "region")
    entities = nation.select(_id("n", "n_nationkey").alias("id"), F.col("n_name").alias("name")).unionByName(region.select(_id("r", "r_regionkey").alias("id"), F.col("r_name").alias("name")))
    made = nation.where("n_nationkey % 5 > 0").select(F.lit("belongsTo").alias("type"), _id("n", "n_nationkey").alias("source_id"), _id("r", "n_regionkey").alias("target_id"))
    made = made.unionByName(spark.createDataFrame([("belongsTo", "n1", "gone")], made.schema))
    gold = nation.where("n_nationkey % 4 > 0").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit("belongsTo").alias("type"), F.concat(F.lit(" "), "n_name").alias("source"), F.col("r_name").alias("target"))
    return evaluation.relation_scores(made, entities, gold).select("kind", "tp", "fp", "fn")


# --- scalars, documents, extraction --------------------------------------------------------------------------------------------


@query("SELECT p_partkey, i, round(CAST(list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(i || ':' || p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS DOUBLE) / 4294967295 * 2 - 1, 5) AS value FROM part, range(16) r(i)")
def hashed_embeddings(spark, sf):
    rows = star.table(spark, sf, "part").select("p_partkey", F.posexplode(tx.hashed_embedding(F.col("p_name"))).alias("i", "value"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("i"), F.round(F.col("value").cast("double"), 5).alias("value"))


@query("SELECT p_partkey, i, round(((list_sum(list_transform(string_split(p_name, ''), lambda c: ascii(c)))::BIGINT * i) % 97) / 97.0, 8) AS value FROM part, range(1, 9) r(i)")
def pseudo_embeddings(spark, sf):
    rows = star.table(spark, sf, "part").select("p_partkey", F.posexplode(tx.pseudo_embedding(F.col("p_name"))).alias("i", "value"))
    return rows.select("p_partkey", (F.col("i") + 1).cast("long").alias("i"), F.round("value", 8).alias("value"))


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '—' WHEN 1 THEN p_brand || ', ' || p_size || ', —' WHEN 2 THEN '{\"b\":' || p_size || '}' ELSE CAST(p_size AS VARCHAR) END AS shown FROM part")
def formatted_values(spark, sf):
    k, size = F.col("p_partkey") % 4, _s("p_size")
    text = F.when(k == 0, "null").when(k == 1, F.concat(F.lit('["'), "p_brand", F.lit('",'), size, F.lit(",null]"))).when(k == 2, F.concat(F.lit('{"b":'), size, F.lit("}"))).otherwise(size)
    return star.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), tx.format_value(F.parse_json(text)).alias("shown"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) / 2.0 AS share, 0.5 AS none FROM orders")
def field_completeness(spark, sf):
    k = F.col("o_orderkey")
    return star.table(spark, sf, "orders").select(k.alias("id"), q.field_completeness(q.present(F.when(k % 2 == 0, "x")), q.present(F.when(k % 3 == 0, F.array(F.lit(1))), "array")).alias("share"), q.field_completeness().alias("none"))


@query()
def document_chunks(spark, sf):
    """All documents cut into chunks; the fold over paragraphs is no SQL, so a test holds it against plain Python."""
    docs = star.table(spark, sf, "documents").select(_s("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.regexp_replace("text", "\n", "\n\n").alias("content"), F.lit("plaintext").alias("content_type"), F.lit(None).cast("array<struct<id:string,title:string,content:string>>").alias("sections"))
    return docs_f.document_chunks(docs).select("id", "document", "index", "location", F.length("content").alias("length"))


@query("SELECT count(*) AS calls, CAST(sum(length(text) // 4) AS BIGINT) AS input_tokens, 16 * count(*) AS output_tokens FROM conversations")
def token_usage(spark, sf):
    calls = extraction.FakeGateway().extract(star.table(spark, sf, "conversations").select("text"), "text")
    return extraction.token_usage(calls.drop("answer"))


@query("SELECT doc_id AS id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence' WHEN regexp_matches(text, '[0-9]{3}') THEN 'figures' ELSE 'general' END AS document_type FROM documents")
def document_types(spark, sf):
    docs = star.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return extraction.document_types(docs, [("licence", "(?i)license"), ("figures", "[0-9]{3}")]).select("id", "document_type")


# --- search, reports, extensions ---------------------------------------------------------------------------------------------------


def _lists(spark, sf):
    rows = star.table(spark, sf, "customer").select(_id("c", "c_custkey").alias("id"), "c_acctbal", "c_custkey")
    return [rows.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(50) for score in (F.col("c_acctbal"), F.col("c_acctbal") * (F.col("c_custkey") % 3))]


_TOPS = "WITH a AS (SELECT 'c' || c_custkey AS id, c_acctbal AS score FROM customer ORDER BY score DESC, id LIMIT 50), b AS (SELECT 'c' || c_custkey AS id, c_acctbal * (c_custkey % 3) AS score FROM customer ORDER BY score DESC, id LIMIT 50), u AS (SELECT id, max(score) AS score, count(*) AS k FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY id) "


@query(_TOPS + "SELECT id, round(score, 4) AS score FROM u ORDER BY u.score DESC, id LIMIT 60")
def merged_union(spark, sf):
    return search.merged(_lists(spark, sf), "union", 60).withColumn("score", F.round("score", 4))


@query(_TOPS + "SELECT id, round(score, 4) AS score FROM u WHERE k = 2 ORDER BY u.score DESC, id LIMIT 60")
def merged_intersection(spark, sf):
    return search.merged(_lists(spark, sf), "intersection", 60).withColumn("score", F.round("score", 4))


@query(GRAPH + ", h AS (SELECT id, 1.0 AS score FROM nodes WHERE type IN ('BoundedContext', 'Subdomain') AND lower(name) IN ('asia', 'china')), e AS (SELECT source_id AS id, target_id AS other FROM edges UNION SELECT target_id, source_id FROM edges) SELECT id, CAST(score AS DOUBLE) AS score, 0 AS hop FROM h UNION ALL SELECT DISTINCT other, CAST(0.5 AS DOUBLE), 1 FROM e JOIN h ON h.id = e.id WHERE other NOT IN (SELECT id FROM h)")
def question_evidence(spark, sf):
    nodes, edges = _both(spark, sf)
    return search.retrieved("What of China, in Asia?", nodes.where("type in ('BoundedContext', 'Subdomain')"), edges)


@query("SELECT p_partkey AS id, round(p_size * (p_retailprice / 1000), 6) AS worth FROM part WHERE p_partkey % 3 = 0")
def corrections_queue(spark, sf):
    part = star.table(spark, sf, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_size").alias("impact"), (F.col("p_retailprice") / 1000).alias("confidence"), F.when(F.col("p_partkey") % 3 == 0, "open").otherwise("done").alias("status"))
    return display.corrections(rows).select("id", F.round("worth", 6).alias("worth"))


@query("SELECT l_partkey AS id, round(least(1.0, l_partkey % 90 / 100.0 + least(0.15, 0.05 * (count(DISTINCT l_suppkey) - 1))), 4) AS confidence FROM lineitem GROUP BY l_partkey")
def corroborated_confidence(spark, sf):
    rows = star.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("sources"))
    return rows.select("id", q.corroborated(F.col("id") % 90 / 100, F.col("sources")).alias("confidence"))


@query(GRAPH + "SELECT e.id, e.type, 'source' AS \"end\", 'retired' AS status FROM edges e JOIN nodes n ON n.id = e.source_id AND n.lifecycle_status = 'retired' UNION ALL SELECT e.id, e.type, 'target', 'retired' FROM edges e JOIN nodes n ON n.id = e.target_id AND n.lifecycle_status = 'retired'")
def lifecycle_contradictions(spark, sf):
    nodes, edges = _both(spark, sf)
    return display.lifecycle_contradictions(edges, nodes)


@query("SELECT 'c' || o_custkey AS source_id, 'all' AS target_id, 'F' AS one, 'P' AS other FROM orders GROUP BY o_custkey HAVING count_if(o_orderstatus = 'F') > 0 AND count_if(o_orderstatus = 'P') > 0")
def relationship_contradictions(spark, sf):
    edges = star.table(spark, sf, "orders").select(_id("c", "o_custkey").alias("source_id"), F.lit("all").alias("target_id"), F.col("o_orderstatus").alias("type"))
    return display.relationship_contradictions(edges, [("F", "P")])


@query(_SCORES + ", f AS (SELECT floor((0.5 * least(1.0, score) + 0.5 * other) * 1000000 + 0.5) / 1000000 AS composite, least(1.0, score) AS score, other FROM s) SELECT count(*) AS n, round(avg(composite), 5) AS composite, count_if(composite >= 0.9) AS excellent, count_if(composite >= 0.8 AND composite < 0.9) AS good, count_if(composite >= 0.6 AND composite < 0.8) AS acceptable, count_if(composite < 0.6) AS poor, CAST(count_if(score < 0.6) + count_if(other < 0.6) AS BIGINT) AS alerts FROM f")
def quality_aggregates(spark, sf):
    rows = _scores(spark, sf).withColumn("score", F.least(F.lit(1.0), F.col("score")))
    rows = rows.withColumn("composite", q.round_up_half(0.5 * F.col("score") + 0.5 * F.col("other")))
    return q.aggregates(rows, ["score", "other"]).select("n", F.round("composite", 5).alias("composite"), "excellent", "good", "acceptable", "poor", "alerts")
