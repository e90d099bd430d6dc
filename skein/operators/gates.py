"""Gates that rows pass on their way into the graph. No row is dropped: each gets a status and a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relationship types, the node types their ends may have (None: any), and targets a source may or must have.
EDGE_RULES = [
    ("evaluates", ["Decision"], ["Rule", "BusinessInvariant"], None, 1),
    ("consumes", ["Decision", "Service"], ["ReferenceData", "Event"], None, 0),
    ("constrainedBy", ["Decision", "DomainConcept"], ["BusinessInvariant"], None, 0),
    ("produces", ["Decision"], ["Event", "Command", "StateTransition"], None, 1),
    ("triggeredBy", ["Event", "OrchestrationStep"], ["Decision"], 1, 0),
    ("realizedBy", ["Decision"], ["Service", "Component"], None, 0),
    ("implements", None, None, None, 1),
    ("belongsTo", None, None, 1, 1),
    ("emits", None, None, None, 0),
    ("evidencedBy", None, None, None, 1),
    ("triggers", ["Event", "Command"], ["OrchestrationFlow"], None, 0),
    ("transitionsTo", ["OrchestrationStep"], ["StateTransition"], None, 0),
    ("compensates", ["OrchestrationStep"], ["OrchestrationStep"], None, 0),
    ("invokes", ["OrchestrationStep"], ["Decision"], None, 0),
    ("satisfiedBy", ["RegulatoryRequirement"], ["ProjectSpec", "Rule", "PolicyStatement", "Decision"], None, 0),
    ("obliges", ["RegulatoryRequirement"], ["DomainConcept", "BusinessCapability"], None, 0),
    ("exposes", ["Service"], ["RegulatoryRequirement"], None, 0),
    ("usesReferenceData", ["Service", "Rule", "Decision"], ["ReferenceData"], None, 0),
    ("governs", None, None, None, 0),
    ("fulfils", ["VendorProduct"], ["BusinessCapability"], None, 0),
    ("specifies", ["ProjectSpec"], ["DomainConcept"], None, 0),
    ("realizesVendorCap", ["Service"], ["VendorCapabilityMapping"], None, 0),
]

# Lifecycle states and where each may go.
LIFECYCLE = {"draft": ["draft", "active", "retired"], "active": ["active", "deprecated", "retired"], "deprecated": ["deprecated", "active", "retired"], "retired": ["retired"]}


@dataclass(frozen=True)
class Rules:
    """A registry of relationship types; one that is registered again replaces the old one."""

    rows: tuple = tuple(EDGE_RULES)

    def register(self, name: str, sources: list[str] | None = None, targets: list[str] | None = None, most: int | None = None, least: int = 0) -> Rules:
        return Rules((*(r for r in self.rows if r[0] != name), (name, sources, targets, most, least)))

    def column(self, kind: Column, at: int) -> Column:
        """A rule's part (1: sources, 2: targets, 3: most) for each row's type; null without one."""
        out = F.lit(None)
        for r in self.rows:
            if r[at] is not None:
                out = F.when(kind == r[0], F.array(*map(F.lit, r[at])) if isinstance(r[at], list) else F.lit(r[at])).otherwise(out)
        return out


def lifecycle_allowed(before: Column, after: Column) -> Column:
    ok = F.lit(False)
    for state, to in LIFECYCLE.items():
        ok = ok | ((before == state) & after.isin(*to))
    return before.isNull() | ok


def link_gate(edges: DataFrame, nodes: DataFrame, rules: Rules = Rules(), existing: DataFrame | None = None) -> DataFrame:
    """edges with status (loaded, quarantined, failed) and reason.

    edges: id, type, source_id, target_id, ord (arrival). In this order: keys present, both ends known,
    source type, target type, and not more targets than the type allows, counted in arrival order after
    the targets that ``existing`` edges (source_id, type) have.
    """
    types = nodes.select("id", F.col("type").alias("_type"))
    joined = edges.join(types.select(F.col("id").alias("source_id"), F.col("_type").alias("source_type")), "source_id", "left")
    joined = joined.join(types.select(F.col("id").alias("target_id"), F.col("_type").alias("target_type")), "target_id", "left")
    keys = F.col("source_id").isNotNull() & F.col("target_id").isNotNull() & F.col("type").isNotNull()
    bad = lambda at, end: F.coalesce(~F.array_contains(rules.column(F.col("type"), at), F.col(end)), F.lit(False))
    reason = (
        F.when(~keys, "missing keys")
        .when(F.col("source_type").isNull() | F.col("target_type").isNull(), "dangling")
        .when(bad(1, "source_type"), "source type")
        .when(bad(2, "target_type"), "target type")
    )
    first = joined.withColumn("_reason", reason).withColumn("_most", rules.column(F.col("type"), 3))
    if existing is not None:
        counts = existing.groupBy("source_id", "type").agg(F.count(F.lit(1)).alias("_before"))
        first = first.join(counts, ["source_id", "type"], "left")
    else:
        first = first.withColumn("_before", F.lit(0))
    # only rows of bounded types that passed so far are numbered; the rest goes round the window
    counted = F.col("_reason").isNull() & F.col("_most").isNotNull()
    numbered = first.where(counted).withColumn("_n", F.row_number().over(Window.partitionBy("source_id", "type").orderBy("ord", "id")) + F.coalesce("_before", F.lit(0)))
    rest = first.where(~counted).withColumn("_n", F.lit(None).cast("long"))
    final = numbered.unionByName(rest).withColumn("reason", F.coalesce("_reason", F.when(F.col("_n") > F.col("_most"), "cardinality")))
    status = F.when(F.col("reason").isNull(), "loaded").when(F.col("reason") == "missing keys", "failed").otherwise("quarantined")
    return final.withColumn("status", status).select(*edges.columns, "source_type", "target_type", "status", "reason")


def emit_gate(rows: DataFrame, threshold: float = 0.5, valid: Column | None = None) -> DataFrame:
    """rows with status emitted or excluded and the reason: confidence first, then shape."""
    reason = F.when(~(F.coalesce("confidence", F.lit(0.0)) >= threshold), "confidence")
    if valid is not None:
        reason = reason.when(~F.coalesce(valid, F.lit(False)), "shape")
    return rows.withColumn("reason", reason).withColumn("status", F.when(reason.isNull(), "emitted").otherwise("excluded"))


# Relationship types by the gate that judges them, and the node types that make an edge a behavioural one.
BEHAVIOUR_TYPES = ["OrchestrationFlow", "OrchestrationStep", "Event", "StateTransition"]
BEHAVIOURAL = ["triggers", "emits", "consumes", "transitionsTo", "compensates", "invokes"]
DECISION_SPECIFIC = ["evaluates", "consumes", "constrainedBy", "triggeredBy", "produces", "realizedBy"]
FUNCTIONAL = ["fulfils", "specifies", "realizesVendorCap"]


def edge_emit_gate(edges: DataFrame, entities: DataFrame, rules: Rules = Rules(), threshold: float = 0.5, valid: Column | None = None) -> DataFrame:
    """edges with source_type, target_type, gate, status (emitted, quarantined, excluded) and reason.

    entities: id, type, status of the entity gate. The first gate that an edge belongs to judges its ends: behavioural
    (with a behaviour at either end), decision (with a decision at either end), functional, or else generic. The first
    three quarantine edges whose ends are not emitted or of a wrong type; the generic one excludes those without emitted
    ends. Confidence and shape come after that. Types of entities that were not emitted are known all the same.
    """
    known = entities.select("id", F.col("type").alias("_type"), (F.col("status") == "emitted").alias("_in"))
    joined = edges
    for end in ("source", "target"):
        joined = joined.join(known.select(F.col("id").alias(f"{end}_id"), F.col("_type").alias(f"{end}_type"), F.col("_in").alias(f"_{end}_in")), f"{end}_id", "left")
    either = lambda types: F.coalesce(F.col("source_type").isin(*types), F.lit(False)) | F.coalesce(F.col("target_type").isin(*types), F.lit(False))
    kind = F.col("type")
    gate = F.when(kind.isin(*BEHAVIOURAL) & either(BEHAVIOUR_TYPES), "behavioural").when(kind.isin(*DECISION_SPECIFIC) & either(["Decision"]), "decision").when(kind.isin(*FUNCTIONAL), "functional").otherwise("generic")
    inside = F.coalesce(F.col("_source_in") & F.col("_target_in"), F.lit(False))
    fits = lambda at, end: F.coalesce(F.array_contains(rules.column(kind, at), F.col(end)), F.lit(True))
    typed = joined.withColumns({"gate": gate, "_inside": inside, "_fits": fits(1, "source_type") & fits(2, "target_type")})
    special = F.col("gate") != "generic"
    reason = F.when(~F.col("_inside"), "ends").when(special & ~F.col("_fits"), "types").when(~(F.coalesce("confidence", F.lit(0.0)) >= threshold), "confidence")
    if valid is not None:
        reason = reason.when(~F.coalesce(valid, F.lit(False)), "shape")
    judged = typed.withColumn("reason", reason)
    status = F.when(F.col("reason").isNull(), "emitted").when(special & F.col("reason").isin("ends", "types"), "quarantined").otherwise("excluded")
    return judged.withColumn("status", status).select(*edges.columns, "source_type", "target_type", "gate", "status", "reason")


def relinked(quarantine: DataFrame, nodes: DataFrame, rules: Rules = Rules(), existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges that load now, what stays in quarantine) of edges that dangled in earlier runs, judged by the link gate again."""
    judged = link_gate(quarantine, nodes, rules, existing)
    return judged.where("status = 'loaded'").select(*quarantine.columns), judged.where("status <> 'loaded'").select(*quarantine.columns, "reason")


def load(edges: DataFrame, nodes: DataFrame, processed: DataFrame, rules: Rules = Rules(), existing: DataFrame | None = None) -> DataFrame:
    """edges (with run_id, entry_id) with status loaded, skipped, failed or quarantined, the reason, and retriable.

    Entries processed before are skipped. Rows without keys fail for good; a quarantined row may load in a later run.
    """
    done = processed.select("run_id", "entry_id").distinct().withColumn("_done", F.lit(True))
    marked = edges.join(done, ["run_id", "entry_id"], "left")
    judged = link_gate(marked.where("_done is null").drop("_done").select(*edges.columns), nodes, rules, existing)
    skipped = marked.where("_done").select(*edges.columns, F.lit("skipped").alias("status"), F.lit("processed before").alias("reason"))
    return judged.select(*edges.columns, "status", "reason").unionByName(skipped).withColumn("retriable", F.col("status") == "quarantined")


def average_confidence(rows: DataFrame) -> DataFrame:
    """n, average (four digits) of the confidence of emitted rows."""
    return rows.where("status = 'emitted'").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("average"))


def status_totals(rows: DataFrame) -> DataFrame:
    """status, n, and the total they add up to."""
    counts = rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy()))


def decision_integrity(decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """id, violations of every decision: what it must evaluate, produce and, if automated, be triggered by."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.count_if(F.col("type") == "evaluates").alias("evaluates"), F.count_if(F.col("type") == "produces").alias("produces"))
    into = edges.where("type = 'triggeredBy'").groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("triggers"))
    joined = decisions.select("id", "decision_type").join(out, "id", "left").join(into, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    each = [F.when(zero("evaluates"), "evaluates nothing"), F.when(zero("produces"), "produces nothing"), F.when((F.col("decision_type") == "automated") & zero("triggers"), "is triggered by nothing")]
    return joined.select("id", F.array_compact(F.array(*each)).alias("violations"))


def missing_fields(fields: list[str]) -> Column:
    """Names of the required fields that a row lacks."""
    return F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))


def schema_check(schema: dict, prefix: str = "") -> Column:
    """A JSON schema's required, enum, const, minimum, maximum, minLength, pattern and minItems as one boolean column."""
    ok = F.lit(True)
    for f in schema.get("required", []):
        ok = ok & F.col(prefix + f).isNotNull()
    for f, rule in schema.get("properties", {}).items():
        c, checks = F.col(prefix + f), []
        if "enum" in rule:
            checks.append(c.isin(*rule["enum"]))
        if "const" in rule:
            checks.append(c == rule["const"])
        if "minimum" in rule:
            checks.append(c >= rule["minimum"])
        if "maximum" in rule:
            checks.append(c <= rule["maximum"])
        if "minLength" in rule:
            checks.append(F.length(c) >= rule["minLength"])
        if "pattern" in rule:
            checks.append(c.rlike(rule["pattern"]))
        if "minItems" in rule:
            checks.append(F.size(c) >= rule["minItems"])
        for check in checks:
            ok = ok & (c.isNull() | check)
    for part in schema.get("allOf", []):
        ok = ok & schema_check(part, prefix)
    return ok


def not_replayed(rows: DataFrame, processed: DataFrame) -> DataFrame:
    """Rows whose (run_id, entry_id) has not been processed."""
    return rows.join(processed.select("run_id", "entry_id"), ["run_id", "entry_id"], "left_anti")


def rolled_back(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows whose first version is not of the run."""
    return rows.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))
