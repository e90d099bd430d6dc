"""Dependency graphs: what depends on each other in circles, layers of the rest, and the edges that say it without repeats.

edges: source_id depends on target_id. Strongly connected components are found in phases. Nodes without an edge in or
out among the rest are components of their own and are trimmed, as often as there are any. Then every node takes the
largest id that reaches it as its colour; a colour's largest node and all of that colour that reach it are a component,
and edges between colours fall away. Every round is a join and an aggregate per node or edge and is written, so no
task sees a node's whole neighbourhood; the number of rounds grows with the longest chain, not with the edges.

Layers are the longest paths of the condensed graph: 0 depends on nothing. Null ends are no edges; a node is known by
its edges, and an edge to itself is a circle of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discarded, settled


def _plain(edges: DataFrame) -> DataFrame:
    return edges.where("source_id is not null and target_id is not null").select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).distinct()


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("s", "t")).alias("id")).distinct()


def _alone(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that have no edge, as components of their own."""
    return settled(nodes.select("id").join(_ends(edges), "id", "left_anti").withColumn("component", F.col("id")), "alone")


def _trimmed(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(edges whose ends all have edges in and out, the nodes that fell away round by round)."""
    gone: list[DataFrame] = []
    while True:
        sources, targets = edges.select(F.col("s").alias("id")).distinct(), edges.select(F.col("t").alias("id")).distinct()
        kept = edges.join(targets.withColumnRenamed("id", "s"), "s", "left_semi").join(sources.withColumnRenamed("id", "t"), "t", "left_semi")
        kept = settled(kept.select("s", "t"), "trimmed")
        fallen = _alone(_ends(edges), kept)
        if fallen.isEmpty():
            return kept, gone
        gone.append(fallen)
        edges = kept


def _coloured(edges: DataFrame) -> DataFrame:
    """id, colour: the largest id that reaches each node, itself included."""
    now = settled(edges.select(F.explode(F.array("s", "t")).alias("id")).distinct().withColumn("colour", F.col("id")), "colours")
    while True:
        pushed = edges.join(now.select(F.col("id").alias("s"), "colour"), "s").groupBy(F.col("t").alias("id")).agg(F.max("colour").alias("_in"))
        new = settled(now.join(pushed, "id", "left").select("id", F.greatest("colour", "_in").alias("colour"), (F.col("_in") > F.col("colour")).alias("_moved")), "colours")
        discarded(now)
        now = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return now


def strong_components(edges: DataFrame) -> DataFrame:
    """id, component: the largest id of the nodes that depend on each other with a node."""
    plain = settled(_plain(edges), "edges")
    left = settled(plain.where("s <> t"), "left")
    found = [_alone(_ends(plain), left)]
    while True:
        left, gone = _trimmed(left)
        found += gone
        if left.isEmpty():
            break
        colours = _coloured(left)
        named = left.join(colours.select(F.col("id").alias("s"), F.col("colour").alias("_c")), "s").join(colours.select(F.col("id").alias("t"), F.col("colour").alias("_d")), "t")
        inner = settled(named.where("_c = _d").select("s", "t"), "coloured-edges")
        frontier = reached = settled(colours.where("id = colour").select("id", F.col("colour").alias("component")), "reached")
        while not frontier.isEmpty():
            back = inner.join(frontier.select(F.col("id").alias("t"), "component"), "t").select(F.col("s").alias("id"), "component").distinct()
            frontier = settled(back.join(reached, ["id", "component"], "left_anti"), "frontier")
            reached = settled(reached.unionByName(frontier), "reached")
        found.append(reached)
        left = settled(inner.join(reached.select(F.col("id").alias("s")), "s", "left_anti").join(reached.select(F.col("id").alias("t")), "t", "left_anti").select("s", "t"), "left")
        found.append(_alone(colours.join(reached, "id", "left_anti"), left))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return settled(out, "strong-components")


def condensed(edges: DataFrame, components: DataFrame) -> DataFrame:
    """source, target: dependencies between components, each once."""
    of = lambda end, name: components.select(F.col("id").alias(end), F.col("component").alias(name))
    both = _plain(edges).join(of("s", "source"), "s").join(of("t", "target"), "t")
    return both.where("source <> target").select("source", "target").distinct()


def layers(links: DataFrame, components: DataFrame) -> DataFrame:
    """component, layer: how many steps the longest chain of dependencies from a component has."""
    now = settled(components.select("component").distinct().withColumn("layer", F.lit(0)), "layers")
    while True:
        below = links.join(now.select(F.col("component").alias("target"), "layer"), "target").groupBy(F.col("source").alias("component")).agg((F.max("layer") + 1).alias("_up"))
        new = settled(now.join(below, "component", "left").select("component", F.greatest("layer", "_up").alias("layer"), (F.col("_up") > F.col("layer")).alias("_moved")), "layers")
        discarded(now)
        now = new.drop("_moved")
        if new.where("_moved").isEmpty():
            return now


def reduced(links: DataFrame, layer: DataFrame) -> DataFrame:
    """Dependencies between components that no chain of others implies.

    A chain takes at least two layers, so only links over more than one are looked at, and from their sources only
    components above the lowest target are reached.
    """
    at = lambda end, name: layer.select(F.col("component").alias(end), F.col("layer").alias(name))
    placed = settled(links.join(at("source", "_high"), "source").join(at("target", "_low"), "target"), "links")
    long = placed.where("_high - _low > 1")
    floor = long.groupBy("source").agg(F.min("_low").alias("_floor"))
    reach = settled(placed.join(floor, "source").where("_low > _floor").select(F.col("source").alias("from"), F.col("target").alias("x"), "_floor"), "reach")
    frontier = reach
    while not frontier.isEmpty():
        onward = frontier.join(placed.select(F.col("source").alias("x"), F.col("target").alias("_next"), "_low"), "x").where("_low > _floor").select("from", F.col("_next").alias("x"), "_floor").distinct()
        frontier = settled(onward.join(reach, ["from", "x"], "left_anti"), "frontier")
        reach = settled(reach.unionByName(frontier), "reach")
    implied = reach.select(F.col("from").alias("source"), "x").join(placed.select(F.col("source").alias("x"), "target"), "x").select("source", "target").distinct()
    return placed.select("source", "target").join(implied, ["source", "target"], "left_anti")


def members(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, component, size, layer; links between components; layers of components)."""
    components = strong_components(edges)
    links = settled(condensed(edges, components), "condensed")
    depth = layers(links, components)
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return components.join(sizes, "component").join(depth, "component").select("id", "component", "size", "layer"), links, depth


def dependency_view(edges: DataFrame) -> dict[str, DataFrame]:
    """members (id, component, size, layer), links (source, target) without implied ones, circles (component, size above 1)."""
    placed, links, depth = members(edges)
    return {"members": placed, "links": reduced(links, depth), "circles": placed.where("size > 1").select("component", "size").distinct()}
