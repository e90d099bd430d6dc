"""Graph patterns: named nodes with types and conditions, joined by hops, matched by semi-joins and then joins.

Each hop is a table of its two ends. Before any join, hops are reduced by semi-joins along a spanning tree of the
pattern, from the leaves to the root and back, so that of a pattern without circles only rows are left that some match
has, and no intermediate result exceeds the input and the matches. Hops that close a circle take part in both passes.
The reduced tables are written and measured, and joined in the order of their estimated results, smallest first;
a hop whose ends are both known already is a filter and comes before any other. Spark picks each join's form.

Cases: a node may match several names, an edge only one hop of a match; hops of several steps give the pairs that walks
of so many edges connect, with the least number of steps; a pattern of one node and no hop is a scan; a pattern that
falls apart is refused, as it would pair everything with everything. In a pattern with circles the two hops joined
first may meet more often than the circle closes; estimates choose them, but do not bound that.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import settled


@dataclass(frozen=True)
class Node:
    """A type (None: any) and a condition on the columns of nodes, as SQL."""

    type: str | None = None
    where: str | None = None


@dataclass(frozen=True)
class Hop:
    """An edge from a named node to another, or a walk of ``least`` to ``most`` edges; types: None for any."""

    source: str
    target: str
    types: tuple[str, ...] | None = None
    name: str | None = None
    least: int = 1
    most: int = 1

    def kinds(self) -> Column:
        return F.lit(True) if self.types is None else F.col("type").isin(*self.types)


@dataclass(frozen=True)
class Pattern:
    nodes: dict[str, Node]
    hops: list[Hop] = field(default_factory=list)

    def names(self) -> list[str]:
        return [h.name or f"{h.source}_{h.target}_{i}" for i, h in enumerate(self.hops)]

    def tree(self) -> list[tuple[int, str]]:
        """(hop, name that it shares with the tree before it) of a spanning tree; hops within the tree come last."""
        known, order, left = {next(iter(self.nodes))}, [], list(range(len(self.hops)))
        while left:
            near = [i for i in left if {self.hops[i].source, self.hops[i].target} & known]
            if not near:
                break
            grows = [i for i in near if not {self.hops[i].source, self.hops[i].target} <= known] or near
            hop = self.hops[grows[0]]
            order.append((grows[0], hop.source if hop.source in known else hop.target))
            known |= {hop.source, hop.target}
            left.remove(grows[0])
        if left or known != set(self.nodes):
            raise ValueError("a pattern has to hang together")
        return order


def walks(edges: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """source, target, steps: pairs connected by walks of least to most edges from starts (id), with the fewest steps in that range."""
    hop = edges.select(F.col("source_id").alias("target"), F.col("target_id").alias("_next")).distinct()
    now = starts.select(F.col("id").alias("source"), F.col("id").alias("target"))
    found = None
    for steps in range(1, most + 1):
        now = settled(now.join(hop, "target").select("source", F.col("_next").alias("target")).distinct(), "walks")
        if steps >= least:
            rows = now.withColumn("steps", F.lit(steps))
            found = rows if found is None else found.unionByName(rows)
    return found.groupBy("source", "target").agg(F.min("steps").alias("steps"))


def _candidates(nodes: DataFrame, node: Node) -> DataFrame | None:
    """Ids that a named node may match; None for all."""
    if node.type is None and node.where is None:
        return None
    rows = nodes if node.type is None else nodes.where(F.col("type") == node.type)
    return (rows if node.where is None else rows.where(node.where)).select("id").distinct()


def _hop_table(nodes: DataFrame, edges: DataFrame, pattern: Pattern, i: int) -> DataFrame:
    """A hop's ends under their names, and its edge or number of steps."""
    hop, name = pattern.hops[i], pattern.names()[i]
    rows = edges.where(hop.kinds())
    if (hop.least, hop.most) == (1, 1):
        table = rows.select(F.col("source_id").alias("_s"), F.col("target_id").alias("_t"), F.col("id").alias(name))
    else:
        starts = _candidates(nodes, pattern.nodes[hop.source])
        starts = rows.select(F.col("source_id").alias("id")).distinct() if starts is None else starts
        table = walks(rows, starts, hop.least, hop.most).select(F.col("source").alias("_s"), F.col("target").alias("_t"), F.col("steps").alias(name))
    for end, of in (("_s", hop.source), ("_t", hop.target)):
        allowed = _candidates(nodes, pattern.nodes[of])
        if allowed is not None:
            table = table.join(allowed.select(F.col("id").alias(end)), end, "left_semi")
    if hop.source == hop.target:
        return table.where("_s = _t").select(F.col("_s").alias(hop.source), name)
    return table.select(F.col("_s").alias(hop.source), F.col("_t").alias(hop.target), name)


def _reduced(tables: list[DataFrame], pattern: Pattern) -> list[DataFrame]:
    """The hops' tables after semi-joins from the leaves of the spanning tree to its root, and back."""
    tables, order = list(tables), pattern.tree()
    ends = [{h.source, h.target} for h in pattern.hops]

    def narrow(this: int, by: int) -> None:
        for name in sorted(ends[this] & ends[by]):
            tables[this] = tables[this].join(tables[by].select(name).distinct(), name, "left_semi")

    before = {i: [j for j, _ in order[:k] if ends[i] & ends[j]] for k, (i, _) in enumerate(order)}
    # a hop hangs on the first one that has the name they share; one that closes a circle on the firsts of both its names
    hangs = {i: sorted({next(j for j in before[i] if n in ends[j]) for n in ends[i] if any(n in ends[j] for j in before[i])}) for i in before}
    for i, _ in reversed(order):
        tables[i] = settled(tables[i], "hop")
        for j in hangs[i]:
            narrow(j, i)
    for i, _ in order:
        for j in hangs[i]:
            narrow(i, j)
        tables[i] = settled(tables[i], "hop")
    return tables


def _measured(table: DataFrame, ends: set[str]) -> tuple[int, dict[str, int]]:
    """Rows of a table, and about how many different ids each end has."""
    row = table.agg(F.count(F.lit(1)).alias("_rows"), *(F.approx_count_distinct(e).alias(e) for e in ends)).first()
    return row["_rows"], {e: max(1, row[e]) for e in ends}


def join_order(sizes: list[tuple[int, dict[str, int]]]) -> list[int]:
    """Hops in the order of their joins, from (rows, different ids per name) of each."""
    left = list(range(len(sizes)))
    first = min(left, key=lambda i: sizes[i][0])
    order, known, rows = [first], dict(sizes[first][1]), sizes[first][0]
    left.remove(first)
    while left:

        def joined(i: int, rows: int = rows, known: dict[str, int] = known) -> float:
            out = float(rows) * sizes[i][0]
            for name in sizes[i][1].keys() & known.keys():
                out /= max(sizes[i][1][name], known[name])
            return out

        near = [i for i in left if sizes[i][1].keys() & known.keys()]
        best = min(near, key=lambda i: (not sizes[i][1].keys() <= known.keys(), joined(i)))
        rows = max(1, int(joined(best)))
        known = {n: min(v, known.get(n, v)) for n, v in (known | sizes[best][1]).items()}
        order.append(best)
        left.remove(best)
    return order


def matches(nodes: DataFrame, edges: DataFrame, pattern: Pattern) -> DataFrame:
    """One row per match: the id under each node's name, and under each hop's name its edge, or the steps of a walk."""
    order = pattern.tree()
    if not order:
        only = next(iter(pattern.nodes))
        found = _candidates(nodes, pattern.nodes[only])
        return (nodes.select("id").distinct() if found is None else found).withColumnRenamed("id", only)
    tables = _reduced([_hop_table(nodes, edges, pattern, i) for i in range(len(pattern.hops))], pattern)
    ends = [{h.source, h.target} for h in pattern.hops]
    names, out = pattern.names(), None
    for i in join_order([_measured(t, e) for t, e in zip(tables, ends, strict=True)]):
        if out is None:
            out, have, taken = tables[i], set(ends[i]), [i]
            continue
        out = out.join(tables[i], sorted(have & ends[i]))
        single = [j for j in (*taken, i) if (pattern.hops[j].least, pattern.hops[j].most) == (1, 1)]
        for j in single[:-1] if i in single else []:
            a, b = pattern.hops[i].types, pattern.hops[j].types
            if a is None or b is None or set(a) & set(b):
                out = out.where(F.col(names[i]) != F.col(names[j]))
        have |= ends[i]
        taken.append(i)
    return out.select(*pattern.nodes, *names)


def chain(kinds: list[str | None]) -> Pattern:
    """A straight pattern of out-edges: type of node, of edge, of node, ...; nodes are n0, n1, ... and edges e0, e1, ..."""
    many = len(kinds) // 2
    return Pattern({f"n{i}": Node(kinds[2 * i]) for i in range(many + 1)}, [Hop(f"n{i}", f"n{i + 1}", None if kinds[2 * i + 1] is None else (kinds[2 * i + 1],), f"e{i}") for i in range(many)])
