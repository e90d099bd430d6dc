"""What displays need of a graph: layers, normalised rows, extra columns, groups, seeds to start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph

# The layer of each type; unknown types are in L1.
LAYERS = {
    "L1": ["Subdomain", "BoundedContext", "DomainConcept", "Decision", "Rule", "BusinessInvariant", "BusinessCapability", "ReferenceData", "ReferenceCapability", "CapabilityClassification"],
    "L2": ["VendorProduct", "VendorCapabilityMapping", "ProjectSpec"],
    "L3": ["OrchestrationFlow", "OrchestrationStep", "Event", "StateTransition", "Service"],
}


def layer(kind: Column) -> Column:
    out = F.lit("L1")
    for name, kinds in LAYERS.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


def normalised(rows: DataFrame) -> DataFrame:
    """rows with a name (the id where it is blank) and a layer."""
    return rows.withColumns({"name": F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("id")), "layer": layer(F.col("type"))})


def extra_columns(rows: DataFrame, data: str = "data", most: int = 3) -> list[str]:
    """The first few further keys, by name, of rows that are all of one type; none otherwise."""
    if rows.select("type").distinct().limit(2).count() != 1:
        return []
    keys = rows.select(F.explode(F.json_object_keys(data)).alias("key")).distinct()
    return [r["key"] for r in keys.orderBy("key").limit(most).collect()]


def type_summary(nodes: DataFrame) -> DataFrame:
    """type, layer, n, share of all."""
    counts = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("type", layer(F.col("type")).alias("layer"), "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def concept_model(nodes: DataFrame) -> DataFrame:
    """layer, types (sorted), n."""
    return nodes.groupBy(layer(F.col("type")).alias("layer")).agg(F.sort_array(F.collect_set("type")).alias("types"), F.count(F.lit(1)).alias("n"))


def relationship_groups(detail: DataFrame) -> DataFrame:
    """type, direction, n of one entry's relationships."""
    return detail.groupBy("type", "direction").agg(F.count(F.lit(1)).alias("n"))


def seeds(nodes: DataFrame, priority: list[str], most: int = 5) -> DataFrame:
    """ids of up to ``most`` nodes of the first type in the list that has any."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("type"))
    ranked = nodes.where(F.col("type").isin(*priority)).withColumn("_rank", rank)
    return ranked.orderBy("_rank", "id").limit(most).withColumn("_best", F.min("_rank").over(Window.partitionBy())).where("_rank = _best").select("id")


def first_view(nodes: DataFrame, edges: DataFrame, priority: list[str]) -> tuple[DataFrame, DataFrame]:
    """What is within three steps of the seeds, in either direction."""
    return graph.traverse(nodes, edges, seeds(nodes, priority), "both", depth=3)


def merge_report(remap: DataFrame, names: DataFrame) -> DataFrame:
    """survivor, names (of what was merged into it, sorted), n; largest first."""
    merged = remap.join(names.select("id", "name"), "id").groupBy("survivor").agg(F.sort_array(F.collect_list("name")).alias("names"), F.count(F.lit(1)).alias("n"))
    return merged.orderBy(F.col("n").desc(), "survivor")


def cluster_sizes(blocks: DataFrame) -> DataFrame:
    """size, clusters."""
    return blocks.groupBy("component", "block").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("clusters"))


# --- reports over quality and runs (extensions) -------------------------------------------------------


def worst_per_dimension(scores: DataFrame, dimensions: list[str], most: int = 10) -> DataFrame:
    """dimension, id, value of the lowest scores in each dimension."""
    long = scores.select("id", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("double").alias("value")) for d in dimensions])).alias("_d")).select("_d.dimension", "id", "_d.value")
    # per dimension only the candidates of each task reach the window, as Spark pushes the rank limit below the exchange
    return long.withColumn("_n", F.row_number().over(Window.partitionBy("dimension").orderBy("value", "id"))).where(F.col("_n") <= most).drop("_n")


def drill_down(scores: DataFrame, levels: list[str]) -> DataFrame:
    """levels..., n, score: averages by each level and overall, in one pass."""
    return scores.groupingSets([[], *[[F.col(x)] for x in levels]], *levels).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))


def trend(scores: DataFrame, width: str = "1 day") -> DataFrame:
    """start, n, score over time."""
    timed = scores.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score")).select(F.col("window.start").alias("start"), "n", "score")


def stale(rows: DataFrame, now: str, days: int) -> DataFrame:
    """source, n, oldest of what has not been evidenced for so many days."""
    old = rows.where(F.col("evidenced_at") < F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))
    return old.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("evidenced_at").alias("oldest"))


def contradictions(claims: DataFrame) -> DataFrame:
    """subject, field, kinds (distinct values), kept (the one to trust): claims that disagree while both hold.

    claims: subject, field, value, valid_from, valid_to (null: still), authority (a weight), stated_at, confidence.
    Of values that hold at the same time, authority, then recency, then confidence decide. Intervals of
    one value are merged first; then two values meet if and only if an interval starts before the latest
    end so far, and that end is another value's, so no pairs are made.
    """
    end = F.coalesce("valid_to", F.lit("9999-12-31").cast("timestamp_ntz"))
    own = Window.partitionBy("subject", "field", "value").orderBy("valid_from", "_end")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    marked = claims.withColumn("_end", end).withColumn("_new", (F.coalesce(F.col("valid_from") > F.max("_end").over(before), F.lit(True))).cast("int"))
    merged = marked.withColumn("_island", F.sum("_new").over(own)).groupBy("subject", "field", "value", "_island").agg(F.min("valid_from").alias("valid_from"), F.max("_end").alias("_end"))
    prior = Window.partitionBy("subject", "field").orderBy("valid_from", "_end", "value").rowsBetween(Window.unboundedPreceding, -1)
    met = merged.withColumn("_latest", F.max(F.struct("_end", "value")).over(prior))
    hit = met.where((F.col("_latest._end") > F.col("valid_from")) & (F.col("_latest.value") != F.col("value"))).select("subject", "field").distinct()
    both = claims.join(hit, ["subject", "field"], "left_semi")
    best = both.groupBy("subject", "field").agg(F.countDistinct("value").alias("kinds"), F.max(F.struct("authority", "stated_at", "confidence", "value")).alias("_b"))
    return best.select("subject", "field", "kinds", F.col("_b.value").alias("kept"))


def corrections(proposals: DataFrame) -> DataFrame:
    """Open proposals (id, impact, confidence, status) by what they are worth: impact times confidence, then id."""
    worth = F.col("impact") * F.col("confidence")
    return proposals.where("status = 'open'").withColumn("worth", worth).orderBy(F.col("worth").desc(), "id")


def lifecycle_contradictions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, type, end, status of edges that lead to or from retired nodes."""
    gone = nodes.where("lifecycle_status = 'retired'").select("id", "lifecycle_status")
    part = lambda end: edges.select("id", "type", F.col(f"{end}_id").alias("_end")).join(gone.select(F.col("id").alias("_end"), F.col("lifecycle_status").alias("status")), "_end").select("id", "type", F.lit(end).alias("end"), "status")
    return part("source").unionByName(part("target"))


def relationship_contradictions(edges: DataFrame, opposed: list[tuple[str, str]]) -> DataFrame:
    """source_id, target_id, one, other: pairs of ends that have edges of two types that deny each other."""
    kinds = edges.groupBy("source_id", "target_id").agg(F.collect_set("type").alias("_t"))
    each = F.array_compact(F.array(*[F.when(F.array_contains("_t", a) & F.array_contains("_t", b), F.struct(F.lit(a).alias("one"), F.lit(b).alias("other"))) for a, b in opposed]))
    return kinds.select("source_id", "target_id", F.explode(each).alias("_c")).select("source_id", "target_id", "_c.one", "_c.other")
