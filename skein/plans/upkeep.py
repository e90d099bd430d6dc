"""Views kept up to date by batches of changes, reading and writing only what a batch touches.

Changes are rows with a multiplicity ``m``: 1 for a row that comes, -1 for one that goes; an update is both. Base tables
and views are kept as counted rows in states: Parquet by bucket of a key's hash. A batch finds the keys that it touches,
reads their buckets, takes back what their old rows gave to a view and adds what their new rows give: for a join
A x B that is new(A) x new(B) - old(A) x old(B) over the touched keys, and a distinct count moves where a row's
multiplicity leaves or reaches zero. Sums of these differences are merged per key, and only touched buckets are
written again.

A batch takes effect when its manifest (which bucket is in which folder) is created, under a name that must be free,
so batches are all or nothing, a batch that is repeated is skipped by its number, and readers keep the version they
opened. Folders that no manifest of the last versions names are deleted by ``vacuum``.

Base tables: nodes (id, type, name, kind of row by type), edges (id, type, source_id, target_id; ids are unique), mappings
(id, target_id, coverage). Cases: rows with null keys share one bucket; a row that comes twice and goes once stays;
changes that cancel out touch nothing; an empty batch only advances the version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import realisation
from .keyed import BUCKETS, Keyed, columns, summed
from .tables import discarded, settled

NODE = "id string, type string, name string"
EDGE = "id string, type string, source_id string, target_id string"
MAPPING = "id string, target_id string, coverage string"
MEMBER, ROWS = ["DomainConcept", "Service"], ["BusinessCapability", "DomainConcept"]

#: State: (columns that identify a row, the one it is bucketed by, columns that are summed).
STATES = {
    "nodes": (NODE, "id", ["m"]),
    "edges_out": (EDGE, "source_id", ["m"]),
    "edges_in": (EDGE, "target_id", ["m"]),
    "contexts": ("id string", "id", ["contexts", "concepts", "services"]),
    "links": ("source string, target string, type string", "source", ["strength"]),
    "elements": ("id string", "id", ["rows", "fulfils", "specifies", "technical", "incoming", "full", "mapped"]),
}
#: States that are views; the others are base tables.
VIEWS = ("contexts", "links", "elements")


def _there(rows: DataFrame) -> DataFrame:
    return rows.where("m > 0").drop("m")


def _signed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows that come (1) and go (-1)."""
    return new.withColumn("_d", F.lit(1)).unionByName(old.withColumn("_d", F.lit(-1)))


class Upkeep(Keyed):
    """The base tables and views; ``version`` is the number of the last batch that took effect.

    ``views`` names the views that batches keep up (contexts, links, elements), set once for a folder like ``buckets``;
    the others stay empty and cannot be read.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, views: tuple[str, ...] = VIEWS) -> None:
        super().__init__(spark, folder, STATES, buckets)
        self.views, self._steps = views, []

    def _view(self, name: str) -> DataFrame:
        if name not in self.views:
            raise ValueError(f"{name} is not kept up here")
        return self._read(name)

    # --- batches ---

    def apply(self, number: int, nodes: DataFrame | None = None, edges: DataFrame | None = None, mappings: DataFrame | None = None) -> bool:
        """Take in a batch's changes; False if it has taken effect before. Numbers rise from batch to batch."""
        if number <= self.version:
            return False
        none = lambda kind: self.spark.createDataFrame([], f"{kind}, m bigint")
        take = lambda df, kind: none(kind) if df is None else df.select(*columns(kind), F.col("m").cast("long").alias("m"))
        dn = self._step(summed(take(nodes, NODE), columns(NODE), ["m"]), "changed-nodes")
        de = self._step(summed(take(edges, EDGE), columns(EDGE), ["m"]), "changed-edges")
        dm = take(mappings, MAPPING)
        where = dict(self._where)
        graph = not (dn.isEmpty() and de.isEmpty())
        if graph:
            where |= {name: self._merged(name, delta, number, ready=True) for name, delta in {"nodes": dn, "edges_out": de, "edges_in": de}.items()}
            of = {"contexts": self._context_changes, "links": self._link_changes}
            touched = self._touched_members(dn, de) if set(of) & set(self.views) else None
            where |= {name: self._merged(name, changes(touched, dn, de), number) for name, changes in of.items() if name in self.views}
        if "elements" in self.views and (graph or mappings is not None):
            where["elements"] = self._merged("elements", self._element_changes(dn, de, dm), number)
        self._commit(number, where)
        discarded(*self._steps)
        self._steps = []
        return True

    def _step(self, rows: DataFrame, label: str) -> DataFrame:
        """Settled rows that nothing reads once the batch has taken effect."""
        self._steps.append(out := settled(rows, label))
        return out

    # --- old and new rows of touched keys ---

    def _nodes_of(self, ids: DataFrame, dn: DataFrame) -> tuple[DataFrame, DataFrame]:
        old = self._at("nodes", ids)
        new = summed(old.unionByName(dn.join(ids.select("id").distinct(), "id", "left_semi")), columns(NODE), ["m"])
        return _there(old), _there(new)

    def _edges_of(self, name: str, ids: DataFrame, de: DataFrame) -> tuple[DataFrame, DataFrame]:
        _, by, _ = STATES[name]
        old = self._at(name, ids)
        mine = de.join(ids.select(F.col("id").alias(by)).distinct(), by, "left_semi").select(*old.columns)
        return _there(old), _there(summed(old.unionByName(mine), columns(EDGE), ["m"]))

    def _touched_members(self, dn: DataFrame, de: DataFrame) -> DataFrame:
        """Ids whose type or context may change: changed nodes, sources of changed memberships, members of changed contexts."""
        own = dn.select("id").unionByName(de.where("type = 'belongsTo'").select(F.col("source_id").alias("id")))
        contexts = dn.where("type = 'BoundedContext'").select("id")
        held = self._at("edges_in", contexts).where("type = 'belongsTo'").select(F.col("source_id").alias("id"))
        return self._step(own.unionByName(held).distinct(), "touched")

    def _context_changes(self, touched: DataFrame, dn: DataFrame, de: DataFrame) -> DataFrame:
        old_n, new_n = self._nodes_of(touched, dn)
        old_e, new_e = self._edges_of("edges_out", touched, de)

        def members(e: DataFrame, n: DataFrame) -> DataFrame:
            kinds = n.select(F.col("id").alias("source_id"), F.col("type").alias("kind")).where(F.col("kind").isin(*MEMBER))
            return e.where("type = 'belongsTo'").select("source_id", "target_id").distinct().join(kinds, "source_id")

        moved = _signed(members(new_e, new_n), members(old_e, old_n))
        zero = F.lit(0)
        counts = moved.select(F.col("target_id").alias("id"), zero.alias("contexts"), F.when(F.col("kind") == "DomainConcept", F.col("_d")).otherwise(0).alias("concepts"), F.when(F.col("kind") == "Service", F.col("_d")).otherwise(0).alias("services"))
        there = _signed(new_n, old_n).where("type = 'BoundedContext'").select("id", F.col("_d").alias("contexts"), zero.alias("concepts"), zero.alias("services"))
        return counts.unionByName(there)

    def _contexts_of(self, ids: DataFrame, dn: DataFrame, de: DataFrame) -> tuple[DataFrame, DataFrame]:
        """member, context before and after the batch, of some ids: the last by id of the contexts that a member belongs to."""
        old_e, new_e = (e.where("type = 'belongsTo'") for e in self._edges_of("edges_out", ids, de))
        ends = old_e.unionByName(new_e).select(F.col("target_id").alias("id")).distinct()
        old_n, new_n = self._nodes_of(ends, dn)
        of = lambda e, n: e.join(n.where("type = 'BoundedContext'").select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy(F.col("source_id").alias("member")).agg(F.max("target_id").alias("context"))
        return of(old_e, old_n), of(new_e, new_n)

    def _link_changes(self, touched: DataFrame, dn: DataFrame, de: DataFrame) -> DataFrame:
        old_c, new_c = self._contexts_of(touched, dn, de)
        moved = self._step(old_c.exceptAll(new_c).unionByName(new_c.exceptAll(old_c)).select(F.col("member").alias("id")).distinct(), "moved")
        own = de.where("type <> 'belongsTo'").select("source_id", "target_id")
        near = self._at("edges_out", moved).select("source_id", "target_id").unionByName(self._at("edges_in", moved).select("source_id", "target_id"))
        pairs = self._step(own.unionByName(near).distinct(), "pairs")
        sources = pairs.select(F.col("source_id").alias("id")).distinct()
        old_e, new_e = (e.where("type <> 'belongsTo'").join(pairs, ["source_id", "target_id"], "left_semi") for e in self._edges_of("edges_out", sources, de))
        ends = sources.unionByName(pairs.select(F.col("target_id").alias("id"))).distinct()
        old_m, new_m = self._contexts_of(ends, dn, de)

        def links(e: DataFrame, m: DataFrame) -> DataFrame:
            s, t = m.select(F.col("member").alias("source_id"), F.col("context").alias("source")), m.select(F.col("member").alias("target_id"), F.col("context").alias("target"))
            return e.distinct().join(s, "source_id").join(t, "target_id").where("source <> target").select("source", "target", "type")

        return _signed(links(new_e, new_m), links(old_e, old_m)).withColumnRenamed("_d", "strength")

    def _element_changes(self, dn: DataFrame, de: DataFrame, dm: DataFrame) -> DataFrame:
        ids = de.select(F.col("target_id").alias("id")).distinct()
        old_e, new_e = self._edges_of("edges_in", ids, de)
        zeros = [F.lit(0).alias(s) for s in STATES["elements"][2]]

        def row(df: DataFrame, **given: Column) -> DataFrame:
            return df.select("id", *(given[s].alias(s) if s in given else z for s, z in zip(STATES["elements"][2], zeros, strict=True)))

        d = F.col("_d")
        when = lambda c: F.when(c, d).otherwise(0)
        counted = row(_signed(new_e, old_e).withColumn("_edge", F.col("id")).withColumn("id", F.col("target_id")), fulfils=when(F.col("type") == "fulfils"), specifies=when(F.col("type") == "specifies"), technical=when(F.col("type").isin(*realisation.TECHNICAL)), incoming=d)
        old_n, new_n = self._nodes_of(dn.select("id").distinct(), dn)
        there = row(_signed(new_n, old_n).where(F.col("type").isin(*ROWS)), rows=d)
        full = realisation.coverage(F.col("coverage"))
        mapped = row(dm.withColumnRenamed("m", "_d").withColumn("id", F.col("target_id")), full=when(full == "full"), mapped=when(full != "none"))
        return counted.unionByName(there).unionByName(mapped)

    # --- views ---

    def context_counts(self) -> DataFrame:
        """id, concepts, services of each bounded context."""
        return self._view("contexts").where("contexts > 0").select("id", "concepts", "services")

    def cross_context(self) -> DataFrame:
        """source, target, type, strength of the edges between members of different contexts."""
        return self._view("links").where("strength > 0")

    def coverage(self) -> DataFrame:
        """id and counts of each capability and concept, whether it is realised, and its status."""
        rows = self._view("elements").where("rows > 0").drop("rows")
        said = rows.withColumns({"any_full": F.col("full") > 0, "any_mapped": F.col("mapped") > 0}).drop("full", "mapped")
        judged = said.withColumns({"functional": (F.col("fulfils") > 0) | (F.col("specifies") > 0) | F.col("any_mapped"), "is_technical": F.col("technical") > 0})
        return judged.withColumn("status", realisation.row_status())

    def gaps(self, layer: str = "both") -> DataFrame:
        """id, name, missing, priority, reason of elements that lack a realisation."""
        names = self._read("nodes").where((F.col("m") > 0) & F.col("type").isin(*ROWS)).select("id", "name")
        return realisation.gaps(self.coverage().join(names, "id"), layer)
