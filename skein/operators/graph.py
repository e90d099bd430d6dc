"""Graph operators: bounded traversal, simple paths, components, forests, impact.

All are joins of a frontier with the edge table, and the frontier is an aggregate; only frontiers of up to
``SMALL`` ids come to the driver, to go into the filter of the next scan. nodes: id, type; edges: id, type,
source_id, target_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discarded, settled

#: How deep walks go if nothing is said, and where the service cuts them.
DEEPEST = 5
#: Ids of a frontier that are written into a filter.
SMALL = 2_000


def steps(edges: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """at, next, edge_id, type: every way an edge may be walked; a self-loop is walked outwards only."""
    chosen = edges.where(F.col("type").isin(*kinds)) if kinds else edges
    out = chosen.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), F.col("id").alias("edge_id"), "type")
    into = chosen.select(F.col("target_id").alias("at"), F.col("source_id").alias("next"), F.col("id").alias("edge_id"), "type")
    if direction == "out":
        return out
    if direction == "in":
        return into
    return out.unionByName(into.where("at <> next"))


def _few(ids: DataFrame) -> list[str] | None:
    """The ids of a one-column table if they are at most ``SMALL``, else None."""
    rows = ids.distinct().limit(SMALL + 1).collect()
    return None if len(rows) > SMALL else [r[0] for r in rows]


def _from(walk: DataFrame, frontier: DataFrame) -> DataFrame | None:
    """The steps that start in a frontier (column at); a small one becomes a filter that the scan of the edges sees. None: empty."""
    ids = _few(frontier)
    if ids is None:
        return frontier.distinct().join(walk, "at")
    return walk.where(F.col("at").isin(*ids)) if ids else None


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, direction: str = "out", kinds: list[str] | None = None, node_types: list[str] | None = None, depth: int = DEEPEST, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, depth of every node reached; ids of the edges seen on the way), breadth first from ``starts`` (column id).

    With a limit (0 and None: none), only the nearest nodes, those of one depth by id.

    Start nodes are not filtered by type and need not be among the nodes, but only nodes are given back. A node of
    another type is neither reached nor walked through, nor are edges to it seen; edges to nodes reached earlier are.
    The edges are read once per step, through a filter where the frontier has at most ``SMALL`` ids.
    """
    walk = steps(edges, direction, kinds)
    if node_types:
        allowed = nodes.where(F.col("type").isin(*node_types)).select(F.col("id").alias("next"))
        walk = walk.join(allowed, "next", "left_semi").select("at", "next", "edge_id", "type")
    reached = settled(starts.select("id").distinct().withColumn("depth", F.lit(0)))
    seen = walk.select("edge_id").limit(0)
    for d in range(1, depth + 1):
        hop = _from(walk, reached.where(F.col("depth") == d - 1).select(F.col("id").alias("at")))
        if hop is None:
            break
        hop = settled(hop.select("next", "edge_id"))
        seen = seen.unionByName(hop.select("edge_id")) if d > 1 else hop.select("edge_id")
        fresh = hop.select(F.col("next").alias("id")).distinct().join(reached, "id", "left_anti").withColumn("depth", F.lit(d))
        reached = settled(reached.unionByName(fresh))
    found = reached.join(nodes.select("id"), "id", "left_semi").select("id", "depth")
    return found.orderBy("depth", "id").limit(limit) if limit else found, seen.distinct()


def simple_paths(edges: DataFrame, source: str, target: str, depth: int = DEEPEST, limit: int | None = None, kinds: list[str] | None = None) -> DataFrame:
    """nodes, edge_ids, length of every path that repeats no node and stops at the target; out-edges only.

    A source that is the target has none; parallel edges give paths of their own; order: length, then ids. Paths
    grow forwards; as long as the ids that lie within k steps before the target are at most ``SMALL``, a path with k
    steps left only goes on to these.
    """
    walk = steps(edges, "out", kinds)
    near = [{target}]
    while len(near) < depth:
        before = _few(walk.where(F.col("next").isin(*near[-1]) & (F.col("at") != target)).select("at"))
        if before is None or len(near[-1] | set(before)) > SMALL:
            break
        near.append(near[-1] | set(before))
    state = walk.limit(0).select(F.array("at").alias("nodes"), F.array("edge_id").alias("edge_ids"), F.col("next").alias("end"))
    done = state.select("nodes", "edge_ids", F.lit(0).alias("length"))
    for d in range(1, (depth if source != target else 0) + 1):
        left = depth - d
        onward = walk.where(F.col("next").isin(*near[left])) if left < len(near) else walk
        if d == 1:
            grown = onward.where((F.col("at") == source) & (F.col("next") != source))
            grown = grown.select(F.array("at", "next").alias("nodes"), F.array("edge_id").alias("edge_ids"), F.col("next").alias("end"))
        else:
            ends = _few(state.select("end"))
            if ends == []:
                break
            some = onward if ends is None else onward.where(F.col("at").isin(*ends))
            grown = state.join(some.withColumnRenamed("at", "end"), "end").where(~F.array_contains("nodes", F.col("next")))
            grown = grown.select(F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), F.col("next").alias("end"))
        grown = settled(grown)
        done = done.unionByName(grown.where(F.col("end") == target).select("nodes", "edge_ids", F.lit(d).alias("length")))
        state = grown.where(F.col("end") != target)
    ordered = done.orderBy("length", "nodes", "edge_ids")
    return ordered.limit(limit) if limit else ordered


def components(links: DataFrame) -> DataFrame:
    """id, component (its smallest id) for every id in a link (columns a, b).

    Each round hooks every id on to its smallest neighbour and redraws the links between labels, so links
    within a component fall away; rounds grow with the logarithm of a component's width.
    """
    edges = settled(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    state = settled(edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
    while not edges.isEmpty():
        hooks = settled(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("to")))
        ends = settled(hooks.join(hooks.select(F.col("id").alias("to"), F.col("to").alias("end")), "to").select("id", "end"))
        old, past = state, edges
        state = settled(state.join(ends.select(F.col("id").alias("component"), "end"), "component", "left").select("id", F.coalesce("end", "component").alias("component")))
        drawn = edges.join(ends.select(F.col("id").alias("a"), F.col("end").alias("la")), "a").join(ends.select(F.col("id").alias("b"), F.col("end").alias("lb")), "b")
        edges = settled(drawn.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        discarded(old, past, hooks, ends)
    return state


def forest(parents: DataFrame) -> DataFrame:
    """id, parent (null at roots), orphaned, from id, parent as stated.

    A parent that is missing, or the row itself, makes an orphaned root. Of a cycle, the largest id loses
    its parent and becomes a root that is not orphaned. Cycles are found by pointer doubling: once the
    jumps are as long as there are ids left, every id on a cycle has passed all of it.
    """
    ids = parents.select(F.col("id").alias("parent"))
    known = parents.join(ids.withColumn("_there", F.lit(True)), "parent", "left")
    stated = known.select("id", F.when(F.col("_there") & (F.col("parent") != F.col("id")), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & (F.col("_there").isNull() | (F.col("parent") == F.col("id")))).alias("orphaned"))
    stated = settled(stated)
    # jump: where an id is after 2^k steps upwards, and the largest id seen on the way
    jump = stated.where("parent is not null").select("id", F.col("parent").alias("at"), F.greatest("id", "parent").alias("most"))
    steps, left = 1, None
    while left is None or steps < left:
        further = jump.select(F.col("id").alias("at"), F.col("at").alias("then"), F.col("most").alias("more"))
        jump = settled(jump.join(further, "at").select("id", F.col("then").alias("at"), F.greatest("most", "more").alias("most")))
        steps, left = 2 * steps, jump.count()  # ids whose path has ended have dropped out
    cut = jump.where("id = most").join(jump.select(F.col("at").alias("id")).distinct(), "id", "left_semi").select("id", F.lit(True).alias("_cut"))
    return stated.join(cut, "id", "left").select("id", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), "orphaned")


def closure(tree: DataFrame) -> DataFrame:
    """ancestor, id, distance of every row with its ancestors and itself, from a forest without cycles.

    Each round joins the pairs at the largest distance so far with all pairs, which doubles that distance.
    """
    reach = settled(tree.where("parent is not null").select(F.col("parent").alias("ancestor"), "id", F.lit(1).alias("distance")))
    whole = tree.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("distance"))
    steps, most = 1, reach.count()
    while True:
        top = reach.where(F.col("distance") == steps).select("id", F.col("ancestor").alias("at"))
        onward = reach.select(F.col("id").alias("at"), "ancestor", "distance")
        further = settled(top.join(onward, "at").select("ancestor", "id", (F.col("distance") + steps).alias("distance")))
        if further.isEmpty():
            return whole.unionByName(reach)
        if steps >= most:
            raise ValueError("not a forest: a cycle of parents")
        reach, steps = reach.unionByName(further), 2 * steps


def descendant_counts(tree: DataFrame) -> DataFrame:
    return closure(tree).groupBy(F.col("ancestor").alias("id")).agg((F.count(F.lit(1)) - 1).alias("descendants"))


def with_paths(tree: DataFrame, label: str = "name") -> DataFrame:
    """tree with depth and path: the labels from the root down, which sort as the rendered tree does."""
    up = closure(tree).join(tree.select(F.col("id").alias("ancestor"), F.col(label).alias("_label")), "ancestor")
    paths = up.groupBy("id").agg(F.max("distance").alias("depth"), F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("distance", "_label")))), lambda s: s["_label"]).alias("path"))
    return tree.join(paths, "id")


def impact(edges: DataFrame, start: str, severity: float, depth: int = DEEPEST, least: float = 0.1) -> DataFrame:
    """id, score, distance of what a change reaches: severity, edge strength and confidence, less with distance.

    edges may carry strength and confidence, 1 where they do not; each node keeps its best score; scores below
    ``least`` go no further.
    """
    share = lambda c: F.coalesce(c, F.lit(1.0)) if c in edges.columns else F.lit(1.0)
    walk = edges.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"), (share("strength") * share("confidence")).alias("weight"))
    state = walk.where(F.col("at") == start).groupBy("next").agg(F.max("weight").alias("weight"))
    out = None
    for d in range(1, depth + 1):
        factor = severity / (1 + 0.3 * d)
        hit = state.where(F.col("weight") * factor >= least).select(F.col("next").alias("id"), "weight", (F.col("weight") * factor).alias("score"), F.lit(d).alias("distance"))
        hit = settled(hit)
        out = hit.drop("weight") if out is None else out.unionByName(hit.drop("weight"))
        grown = hit.select(F.col("id").alias("at"), F.col("weight").alias("so_far")).join(walk, "at")
        state = grown.groupBy("next").agg(F.max(F.col("so_far") * F.col("weight")).alias("weight"))
    best = out.where(F.col("id") != start).groupBy("id").agg(F.max(F.struct("score", (-F.col("distance")).alias("_d"))).alias("b"))
    return best.select("id", F.col("b.score").alias("score"), (-F.col("b._d")).alias("distance"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two sets of rows by id; of rows with one id, the one of ``a`` stays."""
    first, second = a.withColumn("_o", F.lit(0)), b.withColumn("_o", F.lit(1))
    both = first.unionByName(second, allowMissingColumns=True)
    names = [c for c in both.columns if c not in ("id", "_o")]
    rows = both.groupBy("id").agg(F.min_by(F.struct(*names) if names else F.struct("id"), "_o").alias("_row"))
    return rows.select("id", *[F.col(f"_row.{c}").alias(c) for c in names])


def merged_subgraphs(a: tuple[DataFrame, DataFrame, bool], b: tuple[DataFrame, DataFrame, bool]) -> tuple[DataFrame, DataFrame, bool]:
    """(nodes, edges, truncated) of two subgraphs: nodes once by id, edges once by id or, without one, by ends and type."""
    ends = F.concat("source_id", F.lit("->"), "target_id", F.lit(":"), "type")
    keyed = [g[1].withColumnRenamed("id", "_id").withColumn("id", F.coalesce("_id", ends)) for g in (a, b)]
    edges = merged(*keyed)
    return merged(a[0], b[0]), edges.drop("id").withColumnRenamed("_id", "id"), a[2] or b[2]


def multiplicity(edges: DataFrame) -> DataFrame:
    """source_id, target_id, n: how many edges lead from one node to another."""
    return edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


def contracted(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """source, target, type, n: edges between groups (id, group), for graphs too large to draw; inner edges fall away."""
    of = lambda end, name: groups.select(F.col("id").alias(end), F.col("group").alias(name))
    both = edges.join(of("source_id", "source"), "source_id").join(of("target_id", "target"), "target_id")
    return both.where("source <> target").groupBy("source", "target", "type").agg(F.count(F.lit(1)).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """id, out_degree, in_degree, degree."""
    both = edges.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum(F.col("o") + F.col("i")).alias("degree"))
