"""Analytical views of a graph, each a plan from nodes and edges to flat tables, and the engine that names them.

nodes carry id, type, name and whatever a view reads (subdomain, parent, steps, sequence, ...);
edges id, type, source_id, target_id. Trees come as rows with parent, depth and path; nesting is left to exports.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decision_type, norm
from ..operators import graph, realisation
from .keyed import Keyed

UNASSIGNED = "__unassigned__"
#: Columns of a coverage matrix of all vendors; one with more is refused, not cut.
MOST_COLUMNS = 2_000
#: Names of unclassified capabilities that a summary lists.
NAMED = 50


def _is(kind: str) -> Column:
    return F.col("type") == kind


def in_scope(wanted: str | None) -> Column:
    """Rows named by id or name, whatever the case; all if nothing is wanted."""
    if wanted is None:
        return F.lit(True)
    return (F.lower("id") == wanted.lower()) | (norm(F.col("name")) == wanted.strip().lower())


# --- domain map -------------------------------------------------------------------------------------


def member_contexts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, context of members of bounded contexts; of several contexts the last by id."""
    contexts = nodes.where(_is("BoundedContext")).select(F.col("id").alias("target_id"))
    held = edges.where(_is("belongsTo")).join(contexts, "target_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.max("target_id").alias("context"))
    return nodes.select("id", "type").join(held, "id")


def context_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, subdomain, concepts, services of each bounded context."""
    contexts = nodes.where(_is("BoundedContext"))
    subdomains = nodes.where(_is("Subdomain")).select(F.col("id").alias("target_id"))
    up = edges.where(_is("belongsTo")).join(subdomains, "target_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.min("target_id").alias("_up"))
    members = edges.where(_is("belongsTo")).select("source_id", "target_id").distinct().join(nodes.select(F.col("id").alias("source_id"), F.col("type").alias("kind")), "source_id")
    counts = members.groupBy(F.col("target_id").alias("id")).agg(F.count_if(F.col("kind") == "DomainConcept").alias("concepts"), F.count_if(F.col("kind") == "Service").alias("services"))
    stated = F.col("subdomain") if "subdomain" in nodes.columns else F.lit(None).cast("string")
    joined = contexts.join(up, "id", "left").join(counts, "id", "left")
    return joined.select("id", "name", F.coalesce("_up", stated, F.lit(UNASSIGNED)).alias("subdomain"), F.coalesce("concepts", F.lit(0)).alias("concepts"), F.coalesce("services", F.lit(0)).alias("services"))


def cross_context(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target, type, strength: distinct edges between members of different contexts."""
    members = member_contexts(nodes, edges).select("id", "context")
    kept = edges.where(~_is("belongsTo"))
    both = kept.join(members.select(F.col("id").alias("source_id"), F.col("context").alias("source")), "source_id").join(members.select(F.col("id").alias("target_id"), F.col("context").alias("target")), "target_id")
    return both.where("source <> target").groupBy("source", "target", "type").agg(F.countDistinct("id").alias("strength"))


def domain_map(nodes: DataFrame, edges: DataFrame, subdomain: str | None = None) -> DataFrame:
    """Contexts with counts and relationships (sorted array of target and type), by subdomain."""
    links = cross_context(nodes, edges).groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list(F.struct("target", "type"))).alias("relationships"))
    rows = context_counts(nodes, edges).join(links, "id", "left")
    names = nodes.where(_is("Subdomain")).select(F.col("id").alias("subdomain"), F.col("name").alias("subdomain_name"))
    named = rows.join(names, "subdomain", "left").withColumn("subdomain_name", F.coalesce("subdomain_name", "subdomain"))
    if subdomain is not None:
        named = named.where((F.lower("subdomain") == subdomain.lower()) | (norm(F.col("subdomain_name")) == subdomain.strip().lower()))
    return named.orderBy(F.collate(F.col("subdomain"), "UNICODE"), F.collate(F.col("id"), "UNICODE"))


# --- capability trees -----------------------------------------------------------------------------------


def parents_by_name(rows: DataFrame, stated: str = "parent_name") -> DataFrame:
    """id, parent: the id whose id, name or alias is the stated parent; where several are, the first by id."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>")) if "aliases" in rows.columns else F.array().cast("array<string>")
    keys = rows.select("id", F.explode(F.array_distinct(F.transform(F.concat(F.array("id", "name"), aliases), norm))).alias("key")).where("key <> ''")
    first = keys.groupBy("key").agg(F.min("id").alias("_parent"))
    asked = rows.withColumn("key", norm(F.col(stated)))
    # a stated parent that is nowhere stays stated, so that the row is known to be an orphan
    return asked.join(first, "key", "left").select("id", F.when(F.col(stated).isNotNull() & (F.trim(stated) != ""), F.coalesce("_parent", F.col(stated))).alias("parent"))


def evidence_counts(ids: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, kind, n: distinct neighbours of each id, by their type, in both directions."""
    near = graph.steps(edges, "both").select(F.col("at").alias("id"), F.col("next")).join(ids.select("id"), "id", "left_semi").distinct()
    return near.join(nodes.select(F.col("id").alias("next"), F.col("type").alias("kind")), "next").groupBy("id", "kind").agg(F.count(F.lit(1)).alias("n"))


def capability_map(nodes: DataFrame, edges: DataFrame, root: str | None = None) -> DataFrame:
    """id, name, parent, orphaned, depth, path, descendants, neighbours of every capability once."""
    caps = nodes.where(_is("BusinessCapability"))
    tree = graph.forest(parents_by_name(caps)).join(caps.select("id", "name"), "id")
    rows = graph.with_paths(tree).join(graph.descendant_counts(tree), "id")
    near = evidence_counts(caps, nodes, edges).groupBy("id").agg(F.sum("n").alias("neighbours"))
    rows = rows.join(near, "id", "left").fillna(0, ["neighbours"])
    if root is not None:
        tops = caps.where(in_scope(root)).select(F.col("id").alias("ancestor"))
        rows = rows.join(graph.closure(tree).join(tops, "ancestor", "left_semi").select("id"), "id", "left_semi")
    return rows.orderBy("path")


def business_architecture(nodes: DataFrame, verdicts: DataFrame, least: float | None = None, root: str | None = None) -> dict[str, DataFrame]:
    """tree (id, name, parent, depth, path, descendants), rejected (reason, n), unclassified (id, name), unclassified_summary (n, names: the first 50).

    Reference capabilities are the spine; trusted placements hang their subjects under reference or placed
    capabilities. The last placement of a subject by id counts; what is not reached from a root of the spine
    is unclassified, unless it was rejected.
    """
    refs = nodes.where(_is("ReferenceCapability")).select("id", "name", F.col("parent_name").alias("stated"), F.lit(0).alias("_prio"))
    raw = nodes.where(_is("BusinessCapability")).select("id", "name")
    trusted = verdicts if least is None else verdicts.where(F.col("confidence") >= least)
    placed = trusted.where("disposition = 'placed'").groupBy("subject").agg(F.max_by("assigned_parent", "id").alias("stated"))
    hung = raw.join(placed, raw["id"] == placed["subject"]).select("id", "name", "stated", F.lit(1).alias("_prio"))
    every = refs.unionByName(hung)
    keys = every.select("id", "_prio", F.explode(F.array_distinct(F.transform(F.array("id", "name"), norm))).alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("_prio", "id")).alias("_p")).select("key", F.col("_p.id").alias("_parent"))
    parents = every.withColumn("key", norm(F.col("stated"))).join(first, "key", "left").select("id", F.col("_parent").alias("parent"))
    tree = graph.forest(parents).join(every.select("id", "name", "_prio"), "id")
    rooted = graph.closure(tree).join(tree.where("parent is null and _prio = 0").select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
    tree = tree.join(rooted, "id", "left_semi")
    rejected = trusted.where("disposition = 'rejected'")
    reasons = rejected.groupBy(F.coalesce("rejection_reason", F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "reason")
    handled = tree.select("id").unionByName(rejected.select(F.col("subject").alias("id")))
    rest = raw.join(handled, "id", "left_anti")
    first = rest.select("name").orderBy(F.collate(F.col("name"), "UNICODE"), "name").limit(NAMED).agg(F.collect_list("name").alias("names"))
    drawn = graph.with_paths(tree).join(graph.descendant_counts(tree), "id").drop("_prio", "orphaned")
    if root is not None:
        tops = tree.where(in_scope(root)).select(F.col("id").alias("ancestor"))
        drawn = drawn.join(graph.closure(tree).join(tops, "ancestor", "left_semi").select("id"), "id", "left_semi")
    summary = rest.agg(F.count(F.lit(1)).alias("n")).join(first)  # one row each
    return {"tree": drawn.orderBy("path"), "rejected": reasons, "unclassified": rest.orderBy(F.collate(F.col("name"), "UNICODE")), "unclassified_summary": summary}


# --- behaviour ------------------------------------------------------------------------------------------


def flow_steps(flows: DataFrame, steps: DataFrame) -> DataFrame:
    """flow, step, position, next: steps of each flow by sequence, then id. flows: id, steps (ids); steps: id, sequence."""
    from pyspark.sql import Window

    listed = flows.select(F.col("id").alias("flow"), F.explode(F.array_distinct("steps")).alias("step"))
    known = listed.join(steps.select(F.col("id").alias("step"), "sequence"), "step")
    w = Window.partitionBy("flow").orderBy(F.col("sequence").asc_nulls_last(), "step")
    return known.select("flow", "step", (F.row_number().over(w) - 1).alias("position"), F.lead("step").over(w).alias("next"))


def behaviour_flow(nodes: DataFrame, edges: DataFrame, flow_id: str) -> DataFrame:
    """One row per step in order: emits, consumes, transitions, compensates, decision and its outcomes with the event each produces."""
    flow = nodes.where(_is("OrchestrationFlow") & (F.col("id") == flow_id))
    steps = flow_steps(flow, nodes.where(_is("OrchestrationStep")))
    kinds = nodes.select(F.col("id").alias("target_id"), F.col("type").alias("kind"), F.col("name").alias("target_name"))
    out = edges.join(steps.select(F.col("step").alias("source_id")), "source_id", "left_semi").join(kinds, "target_id").where("kind <> 'OrchestrationStep' or type = 'compensates'")
    pick = lambda kind, target, how: how(F.when(_is(kind) & (F.col("kind") == target), F.col("target_id")))
    wired = out.groupBy(F.col("source_id").alias("step")).agg(
        F.sort_array(pick("emits", "Event", F.collect_set)).alias("emits"), F.sort_array(pick("transitionsTo", "StateTransition", F.collect_set)).alias("transitions"), pick("invokes", "Decision", F.min).alias("decision"), pick("compensates", "OrchestrationStep", F.min).alias("compensates")
    )
    triggers = edges.where(_is("triggers") & (F.col("target_id") == flow_id)).select(F.col("source_id").alias("id")).join(nodes.where(_is("Event")).select("id"), "id", "left_semi")
    consumed = triggers.agg(F.sort_array(F.collect_set("id")).alias("consumes"))
    decisions = nodes.where(_is("Decision")).select(F.col("id").alias("decision"), "outcomes", decision_type(F.col("decision_type")).alias("decision_type"))
    made = edges.where(_is("produces")).join(nodes.where(_is("Event")).select(F.col("id").alias("target_id"), norm(F.col("name")).alias("label")), "target_id").groupBy(F.col("source_id").alias("decision"), "label").agg(F.max("target_id").alias("event"))
    labels = decisions.select("decision", F.posexplode("outcomes").alias("n", "outcome")).join(made, [decisions["decision"] == made["decision"], norm(F.col("outcome")) == made["label"]], "left").select(decisions["decision"], "n", "outcome", "event")
    outcomes = labels.groupBy("decision").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "outcome", "event"))), lambda s: F.struct(s["outcome"].alias("label"), s["event"].alias("event"))).alias("outcomes"))
    rows = steps.join(wired, "step", "left").crossJoin(F.broadcast(consumed)).join(decisions.drop("outcomes"), "decision", "left").join(outcomes, "decision", "left")  # consumed is one row
    first = F.when(F.col("position") == 0, F.col("consumes")).otherwise(F.array().cast("array<string>"))
    return rows.select("flow", "step", "position", "next", "emits", first.alias("consumes"), "transitions", "compensates", "decision", "decision_type", "outcomes").orderBy("position")


# --- coverage and gaps ---------------------------------------------------------------------------------------


def vendor_coverage(rows: DataFrame, edges: DataFrame, mappings: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """rows with their status, cells by row and column, and the summary."""
    assessed = realisation.elements(rows, edges, mappings).withColumn("status", realisation.row_status())
    return {"rows": assessed, "cells": realisation.cells(mappings, claims), "summary": realisation.coverage_summary(assessed)}


def gap_analysis(rows: DataFrame, edges: DataFrame, mappings: DataFrame, layer: str = "both") -> dict[str, DataFrame]:
    """gaps in order of priority, and the summary, which the layer does not narrow."""
    assessed = realisation.elements(rows, edges, mappings)
    return {"gaps": realisation.gaps(assessed, layer), "summary": realisation.gap_summary(assessed)}


def _claims(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").alias("column"), F.explode("claims").alias("capability"))


def coverage_view(nodes: DataFrame, edges: DataFrame, mappings: DataFrame, vendor: str | None = None, domain: str | None = None, row_kind: str = "BusinessCapability") -> dict[str, DataFrame]:
    """rows, columns, cells (one for each row and column) and summary, for one vendor (by vendor, id or name) and one domain.

    nodes carry vendor, claims (array of capabilities) and domain as well. A vendor's matrix is whole, however many products
    it has; without a vendor, one of more than ``MOST_COLUMNS`` products is refused.
    """
    rows = nodes.where(_is(row_kind))
    if domain is not None:
        rows = rows.where(norm(F.col("domain")) == domain.strip().lower())
    products = nodes.where(_is("VendorProduct"))
    if vendor is not None:
        products = products.where((F.lower("vendor") == vendor.lower()) | in_scope(vendor))
    columns = products.select("id", F.coalesce("name", "id").alias("name"), F.coalesce("vendor", F.lit("")).alias("vendor")).orderBy("id")
    assessed = realisation.elements(rows.select("id", "name", "domain"), edges, mappings).withColumn("status", realisation.row_status())
    if vendor is None and products.select("id").limit(MOST_COLUMNS + 1).count() > MOST_COLUMNS:
        raise ValueError(f"a matrix of more than {MOST_COLUMNS} products; name a vendor")
    cells = realisation.matrix(rows, columns, mappings, _claims(products))
    return {"rows": assessed, "columns": columns, "cells": cells, "summary": realisation.coverage_summary(assessed)}


def gap_view(nodes: DataFrame, edges: DataFrame, mappings: DataFrame, domain: str | None = None, layer: str = "both") -> dict[str, DataFrame]:
    """gaps (with kind and domain) and summary of capabilities and concepts, of one domain if asked for."""
    rows = nodes.where(F.col("type").isin("BusinessCapability", "DomainConcept"))
    if domain is not None:
        rows = rows.where(norm(F.col("domain")) == domain.strip().lower())
    assessed = realisation.elements(rows.select("id", "name", F.col("type").alias("kind"), "domain"), edges, mappings)
    found = realisation.gaps(assessed, layer).join(assessed.select("id", "kind", "domain"), "id").orderBy(F.col("priority").desc(), "id")
    return {"gaps": found, "summary": realisation.gap_summary(assessed)}


def context_detail(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: context, id, type, name; the edges that leave members, belongsTo apart) for rendering a domain map."""
    contexts = nodes.where(_is("BoundedContext")).select(F.col("id").alias("target_id"))
    held = edges.where(_is("belongsTo")).join(contexts, "target_id", "left_semi").select(F.col("source_id").alias("id"), F.col("target_id").alias("context")).distinct()
    members = held.join(nodes.select("id", "type", "name"), "id").select("context", "id", "type", "name")
    return members, edges.where(~_is("belongsTo")).join(members.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(*edges.columns)


def matrix_markdown(cells: DataFrame, columns: list[str]) -> str:
    """The cells as a Markdown table; columns are named by the caller, so the pivot is bounded."""
    wide = cells.groupBy("row").pivot("column", columns).agg(F.first("status")).orderBy("row")
    lines = ["| | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join(lines + [f"| {r['row']} | " + " | ".join(r[c] or "" for c in columns) + " |" for r in wide.toLocalIterator()])


#: Fixed texts of the gap report; readers compare them.
GAP_TITLE = "# Gap Analysis"
GAP_HEAD = ["| Priority | Element | Kind | Missing | Reason |", "| --- | --- | --- | --- | --- |"]
GAP_NONE = "_No gaps — every assessed element is realised._"


def gap_lines(view: dict[str, DataFrame]) -> DataFrame:
    """part, priority, id, line: a gap analysis as Markdown lines, a table to be written in the order of its columns."""
    gaps, total = view["gaps"], view["summary"]
    fixed = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("line"))
    counted = lambda column, what: F.concat_ws(" ", F.col(column).cast("string"), F.lit(what), F.when(F.col(column) == 1, "gap").otherwise("gaps"))
    realised = F.format_string("%d fully realised (of %d assessed)", F.col("fully_realised").cast("long"), F.col("total").cast("long"))
    figures = F.concat_ws(" · ", counted("functional_gaps", "functional"), counted("technical_gaps", "technical"), realised)
    ending = F.array(*(fixed(4 + i, F.lit(text)) for i, text in enumerate([GAP_NONE] if gaps.isEmpty() else GAP_HEAD)))
    opening = F.array(fixed(0, F.lit(GAP_TITLE)), fixed(1, F.lit("")), fixed(2, figures), fixed(3, F.lit("")))
    frame = total.select(F.explode(F.concat(opening, ending)).alias("_l")).select("_l.part", F.lit(0).cast("long").alias("priority"), F.lit("").alias("id"), "_l.line")
    cells = F.concat_ws(" | ", F.col("priority").cast("string"), "name", "kind", F.concat_ws(" + ", "missing"), "reason")
    table = gaps.select(F.lit(9).alias("part"), (-F.col("priority")).cast("long").alias("priority"), F.col("id"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    return frame.unionByName(table).orderBy("part", "priority", "id")


def gaps_markdown(view: dict[str, DataFrame]) -> str:
    """The lines of ``gap_lines`` as one text; the gaps of a report that people read."""
    return "\n".join(r["line"] for r in gap_lines(view).toLocalIterator())


class Engine:
    """Views by name; registering a name again replaces it. A view's rows count as its entries unless it says otherwise."""

    def __init__(self) -> None:
        self._views: dict[str, tuple[Callable[..., DataFrame | dict], Callable[..., int]]] = {}
        self._kept: dict[str, Keyed] = {}
        self._announced = 0

    def register(self, name: str, view: Callable[..., DataFrame | dict], included: Callable[..., int] = lambda result: result.count()) -> None:
        self._views[name] = (view, included)

    def keep(self, name: str, tables: Keyed, view: Callable[[], DataFrame]) -> None:
        """Register a view that batches of changes keep up to date; it is stale while a batch is announced that has not come in."""
        self._kept[name] = tables
        self.register(name, lambda *_, **__: view())

    def announce(self, number: int) -> None:
        """A batch of changes of this number is on its way."""
        self._announced = max(self._announced, number)

    def list(self) -> list[str]:
        return sorted(self._views)

    def version(self, name: str) -> int | None:
        """Number of the last batch that a kept view has taken in; None for views that are computed when asked for."""
        return self._kept[name].version if name in self._kept else None

    def get(self, name: str, *tables: DataFrame, **params) -> dict:
        view, included = self._views[name]
        result, at = view(*tables, **params), self.version(name)
        stale = at is not None and at < self._announced
        return {"view": name, "data": result, "computed_at": datetime.now(UTC).isoformat(), "entries_included": included(result), "stale": stale, "cache_hit": False}

    def refresh(self, name: str) -> None:
        """Take the newest version of a kept view's tables; other views are computed when asked for."""
        if name in self._kept:
            self._kept[name].reopen()


def standard_engine() -> Engine:
    out = Engine()
    out.register("domain-map", domain_map)
    out.register("capability-map", capability_map)
    out.register("business-architecture", business_architecture, lambda r: r["tree"].count() + r["unclassified"].count())
    out.register("behaviour-flow", behaviour_flow)
    out.register("vendor-coverage", coverage_view, lambda r: r["rows"].count())
    out.register("gap-analysis", gap_view, lambda r: r["summary"].first()["total"])
    return out


# --- renders ---------------------------------------------------------------------------------------------------


def flow_diagram(steps: DataFrame) -> DataFrame:
    """line: a PlantUML activity of ordered steps, with an arrow to each next one."""
    from ..functions.text import diagram_alias

    node = F.concat(F.lit('rectangle "'), F.regexp_replace("step", '"', "'"), F.lit('" as '), diagram_alias(F.col("step")))
    arrow = F.when(F.col("next").isNotNull(), F.concat(diagram_alias(F.col("step")), F.lit(" --> "), diagram_alias(F.col("next")), F.lit(" : then")))
    return steps.orderBy("flow", "position").select(F.explode(F.array_compact(F.array(node, arrow))).alias("line"))


def _label(column: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(column), F.lit("")), '"', "'")


def domain_diagram(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """line, by place: PlantUML packages of subdomains and contexts with their members, and the edges between members.

    A table to be written in order; a context's lines sort under its subdomain, a member's under its context.
    """
    from ..functions.text import diagram_alias

    counts = context_counts(nodes, edges)
    members, inner = context_detail(nodes, edges)
    names = nodes.where(_is("Subdomain")).select(F.col("id").alias("subdomain"), F.col("name").alias("_sub"))
    placed = counts.join(names, "subdomain", "left").withColumn("_sub", F.coalesce("_sub", "subdomain"))
    none = F.lit("")
    row = lambda df, a, b, c, line: df.select(a.alias("a"), b.alias("b"), c.alias("c"), line.alias("line"))
    sub, ctx = F.col("subdomain"), F.col("id")
    opened = row(placed.select("subdomain", "_sub").distinct(), sub, none, none, F.concat(F.lit('package "'), _label("_sub"), F.lit('" as '), diagram_alias(sub), F.lit(" {")))
    closed = row(placed.select("subdomain").distinct(), sub, F.lit("\uffff"), none, F.lit("}"))
    label = F.concat(F.lit('  package "'), _label("name"), F.lit("\\n"), F.col("concepts").cast("string"), F.lit(" concepts · "), F.col("services").cast("string"), F.lit(' services" as '), diagram_alias(ctx), F.lit(" {"))
    contexts = row(placed, sub, ctx, none, label).unionByName(row(placed, sub, ctx, F.lit("\uffff"), F.lit("  }")))
    inside = members.join(placed.select(F.col("id").alias("context"), "subdomain"), "context")
    boxes = row(inside, sub, F.col("context"), F.concat("type", F.lit("/"), "id"), F.concat(F.lit('    rectangle "'), _label("name"), F.lit('" as '), diagram_alias(ctx), F.lit(" <<"), F.col("type"), F.lit(">>")))
    known = members.select(F.col("id").alias("target_id")).distinct()
    arrows = row(inner.join(known, "target_id", "left_semi"), F.lit("\uffff"), F.col("id"), none, F.concat(diagram_alias(F.col("source_id")), F.lit(" --> "), diagram_alias(F.col("target_id")), F.lit(" : "), F.col("type")))
    lines = opened.unionByName(contexts).unionByName(boxes).unionByName(arrows).unionByName(closed)
    return lines.orderBy("a", "b", "c", "line").select("line")


def behaviour_diagram(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """line, by place: PlantUML of a behaviour subgraph: its nodes, dashed arrows between following steps, its typed edges.

    Edges that leave a decision are bold. steps: step, next, as ``flow_steps`` gives them.
    """
    from ..functions.text import diagram_alias

    shape = F.when(_is("Decision"), "hexagon").when(_is("Event"), "usecase").otherwise("rectangle")
    boxes = nodes.select(F.lit(0).alias("part"), F.col("id").alias("key"), F.concat(shape, F.lit(' "'), _label("name"), F.lit('" as '), diagram_alias(F.col("id")), F.lit(" <<"), F.col("type"), F.lit(">>")).alias("line"))
    order = steps.where("next is not null").select(F.lit(1).alias("part"), F.col("step").alias("key"), F.concat(diagram_alias(F.col("step")), F.lit(" -[dashed]-> "), diagram_alias(F.col("next")), F.lit(" : then")).alias("line"))
    decisions = nodes.where(_is("Decision")).select(F.col("id").alias("source_id"), F.lit(True).alias("_d"))
    arrow = F.when(F.col("_d"), " -[bold]-> ").otherwise(" --> ")
    drawn = graph.induced(nodes, edges).join(decisions, "source_id", "left").select(F.lit(2).alias("part"), F.col("id").alias("key"), F.concat(diagram_alias(F.col("source_id")), arrow, diagram_alias(F.col("target_id")), F.lit(" : "), F.col("type")).alias("line"))
    return boxes.unionByName(order).unionByName(drawn).orderBy("part", "key", "line").select("line")
