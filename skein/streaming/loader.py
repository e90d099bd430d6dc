"""Loading entries of runs into a graph that grows: exactly once per run and entry, with edges that wait for their ends.

A loader is a folder of keyed tables (``plans.keyed``): nodes, edges by their source, a ledger of the entries that took
effect, and a log of edges that wait, keyed by the end that is missing. A batch is mapped, freed of what the ledger
has, and judged by the link gate together with the waiting edges whose missing end came with it; those that lack their
other end too wait on for that one. All of it takes effect with one manifest, so a batch that is cut off or repeated
changes nothing twice. Time runs by ``expire``: edges that have waited since before a moment are quarantined.

Cases: an entry that comes twice in a batch counts once, the rest and those of earlier batches are skipped; entries
that cannot be mapped fail, are not in the ledger, and may come again; edges of wrong types or beyond what their
type allows are quarantined for good; nodes load whatever comes with them; an empty batch only advances the version.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import gates, mapping
from ..plans.keyed import BUCKETS, Keyed, columns
from ..plans.tables import settled
from .ingest import fan_out

EDGE = "run_id string, entry_id string, id string, type string, source_id string, target_id string"
STATES = {
    "nodes": ("id string, type string", "id", ["m"]),
    "edges": (EDGE, "source_id", ["m"]),
    "ledger": ("run_id string, entry_id string", "entry_id", ["m"]),
    "waiting": (f"missing string, since timestamp, {EDGE}", "missing", ["m"]),
}
STATUS = "run_id string, entry_id string, status string, reason string"


class Loader(Keyed):
    """Nodes and edges of all batches so far; ``load`` takes entries with a run_id."""

    def __init__(self, spark: SparkSession, folder: str, rules: gates.Rules = gates.Rules(), buckets: int = BUCKETS) -> None:
        super().__init__(spark, folder, STATES, buckets)
        self.rules = rules

    def nodes(self) -> DataFrame:
        return self._read("nodes").where("m > 0").select("id", "type")

    def edges(self) -> DataFrame:
        return self._read("edges").where("m > 0").drop("m")

    def waiting(self) -> DataFrame:
        """Edges with the end they wait for and the time since when."""
        return self._read("waiting").where("m > 0").drop("m")

    def statuses(self) -> DataFrame:
        """run_id, entry_id, status, reason, version of all entries of all batches; a waiting edge has a row for each change."""
        paths = [f"{self.folder}/statuses/{n}" for n in self._versions()]
        known = [p for p in paths if self._fs.exists(self._path(p))]
        rows = self.spark.read.schema(STATUS).option("basePath", f"{self.folder}/statuses").parquet(*known) if known else self.spark.createDataFrame([], STATUS)
        return rows.withColumn("version", F.regexp_extract(F.input_file_name(), r"statuses/(\d+)/", 1).cast("int")) if known else rows.withColumn("version", F.lit(0))

    def load(self, entries: DataFrame, at: datetime | None = None) -> dict[str, int]:
        """Take in a batch of entries; how many were loaded, skipped, failed, quarantined or wait (dangling)."""
        number, moment = self.version + 1, F.lit(at or datetime.now(UTC)).cast("timestamp")
        batch = settled(entries, "entries")
        done = self._at("ledger", batch.select("id").distinct()).where("m > 0").select("run_id", F.col("entry_id").alias("id"))
        fresh = settled(batch.dropDuplicates(["run_id", "id"]).join(done, ["run_id", "id"], "left_anti"), "fresh")
        repeated = batch.select("run_id", F.col("id").alias("entry_id")).exceptAll(fresh.select("run_id", F.col("id").alias("entry_id")))
        runs = fresh.select("id", "run_id")
        nodes = settled(mapping.entry_nodes(fresh).select("id", "type").join(runs, "id"), "new-nodes")
        mapped = settled(mapping.entry_edges(fresh).select("id", "type", "source_id", "target_id", "problem").join(runs, "id").withColumn("entry_id", F.col("id")), "new-edges")
        freed = settled(self._at("waiting", nodes.select("id").distinct()).where("m > 0"), "freed")
        new = mapped.where("problem is null").select(*columns(EDGE)).withColumn("since", moment)
        judged = settled(self._judged(new.unionByName(freed.select(*columns(EDGE), "since")), nodes), "judged")
        waits = judged.where("status = 'waiting'").select("missing", "since", *columns(EDGE), F.lit(1).alias("m"))
        loaded = judged.where("status = 'loaded'").select(*columns(EDGE), F.lit(1).alias("m"))
        held = mapped.where("problem is null").select("run_id", "entry_id").unionByName(nodes.select("run_id", F.col("id").alias("entry_id")))
        there = self._at("nodes", nodes.select("id").distinct()).select("id", "type")
        where = {
            "nodes": self._merged("nodes", nodes.select("id", "type").distinct().join(there, ["id", "type"], "left_anti").withColumn("m", F.lit(1)), number),
            "edges": self._merged("edges", loaded, number),
            "ledger": self._merged("ledger", held.distinct().withColumn("m", F.lit(1)), number),
            "waiting": self._merged("waiting", waits.unionByName(freed.withColumn("m", -F.col("m"))), number),
        }
        none = F.lit(None).cast("string").alias("reason")
        said = lambda df, status, reason=none: df.select("run_id", "entry_id", F.lit(status).alias("status"), reason)
        told = judged.select("run_id", "entry_id", F.when(F.col("status") == "waiting", "dangling").otherwise(F.col("status")).alias("status"), "reason")
        told = told.unionByName(said(nodes.withColumn("entry_id", F.col("id")), "loaded")).unionByName(said(repeated, "skipped", F.lit("processed before").alias("reason"))).unionByName(said(mapped.where("problem is not null"), "failed", F.col("problem").alias("reason")))
        return self._told(told, number, where)

    def _judged(self, edges: DataFrame, nodes: DataFrame) -> DataFrame:
        """Edges with status (loaded, quarantined, waiting), reason and the end that is missing."""
        ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        known = settled(self._at("nodes", ends).where("m > 0").select("id", "type").unionByName(nodes.select("id", "type")).groupBy("id").agg(F.min("type").alias("type")), "ends")
        existing = self._at("edges", edges.select(F.col("source_id").alias("id")).distinct()).where("m > 0").select("source_id", "type")
        ordered = edges.withColumn("ord", F.struct("since", "entry_id", "run_id"))
        judged = gates.link_gate(ordered, known, self.rules, existing)
        here = known.select("id", F.lit(True).alias("_here"))
        for end in ("source_id", "target_id"):
            judged = judged.join(here.withColumnsRenamed({"id": end, "_here": f"_{end}"}), end, "left")
        missing = F.when(F.col("_source_id").isNull(), F.col("source_id")).when(F.col("_target_id").isNull(), F.col("target_id"))
        out = judged.withColumn("missing", missing)
        return out.select(*columns(EDGE), "since", "missing", F.when(F.col("missing").isNotNull(), "waiting").otherwise(F.col("status")).alias("status"), "reason")

    def _told(self, told: DataFrame, number: int, where: dict) -> dict[str, int]:
        told.select(*columns(STATUS)).write.mode("overwrite").parquet(f"{self.folder}/statuses/{number}")
        self._commit(number, where)
        rows = self.spark.read.schema(STATUS).parquet(f"{self.folder}/statuses/{number}")
        return {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}

    def expire(self, before: datetime) -> dict[str, int]:
        """Quarantine edges that have waited since before a moment; they stay in the ledger and do not come back."""
        number = self.version + 1
        due = settled(self._read("waiting").where((F.col("m") > 0) & (F.col("since") < F.lit(before).cast("timestamp"))), "due")
        where = self._where | {"waiting": self._merged("waiting", due.withColumn("m", -F.col("m")), number)}
        return self._told(due.select("run_id", "entry_id", F.lit("quarantined").alias("status"), F.concat(F.lit("waited for "), "missing").alias("reason")), number, where)


class Loaders:
    """Loaders by name that all get a run's entries, whatever happens to the others; a run's states are kept by loader."""

    def __init__(self, spark: SparkSession, folder: str, loaders: dict[str, Loader]) -> None:
        self.spark, self.folder, self.loaders = spark, folder.rstrip("/"), loaders

    def _log(self, run_id: str, outcomes: list[tuple[str, str, dict[str, int]]]) -> None:
        rows = [(run_id, name, state, counts, datetime.now(UTC).isoformat()) for name, state, counts in outcomes]
        self.spark.createDataFrame(rows, "run_id string, loader string, state string, counts map<string,int>, at string").coalesce(1).write.mode("append").json(f"{self.folder}/runs")

    def run(self, entries: DataFrame, run_id: str) -> dict[str, str]:
        """State of each loader and of the run: completed, partial (some failed entries or loaders), or failed."""
        counts: dict[str, dict[str, int]] = {}
        mine = entries.withColumn("run_id", F.lit(run_id))
        sink = lambda name: lambda batch: counts.__setitem__(name, self.loaders[name].load(batch))
        states = fan_out(mine, {name: sink(name) for name in self.loaders})
        judged = {n: "partial" if s == "completed" and counts[n].get("failed") else s for n, s in states.items() if n != "state"}
        self._log(run_id, [(n, s, counts.get(n, {})) for n, s in judged.items()])
        whole = "completed" if set(judged.values()) == {"completed"} else "failed" if any(s.startswith("failed") for s in judged.values()) else "partial"
        return judged | {"state": whole}

    def replay(self, name: str, entries: DataFrame, run_id: str) -> dict[str, int]:
        """A run's entries once more for one loader; what it has taken in before is skipped."""
        if name not in self.loaders:
            raise ValueError(f"no loader named {name}")
        counts = self.loaders[name].load(entries.withColumn("run_id", F.lit(run_id)))
        self._log(run_id, [(name, "partial" if counts.get("failed") else "completed", counts)])
        return counts

    def status(self, run_id: str) -> DataFrame:
        """loader, state, counts: the last outcome of each loader in a run."""
        rows = self.spark.read.schema("run_id string, loader string, state string, counts map<string,int>, at string").json(f"{self.folder}/runs").where(F.col("run_id") == run_id)
        return rows.groupBy("loader").agg(F.max_by(F.struct("state", "counts"), "at").alias("_l")).select("loader", "_l.state", "_l.counts")


def load_into(stream: DataFrame, loader: Loader, checkpoint: str) -> StreamingQuery:
    """A stream of entries with run_id into a loader; a batch that Spark repeats is skipped by the ledger."""
    return stream.writeStream.foreachBatch(lambda batch, _: loader.load(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def linked(edges: DataFrame, nodes: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """edges (id, type, source_id, target_id, ts) with status linked or quarantined and the ends that were not met.

    nodes: id, ts; an end is met by a node that comes at most ``within`` before or after the edge. For streams both sides
    have watermarks, so Spark keeps a row only until no partner can come, and then gives edges whose ends were not met;
    rows behind the watermark of their side are not seen. Tables give the same rows at once. Node ids come once a span.
    """
    if edges.isStreaming or nodes.isStreaming:
        edges, nodes = edges.withWatermark("ts", late), nodes.withWatermark("ts", late)
    out = edges.withColumnRenamed("ts", "edge_ts")
    for end in ("source", "target"):
        side = nodes.select(F.col("id").alias(f"_{end}"), F.col("ts").alias(f"_{end}_ts"))
        near = F.expr(f"_{end}_ts >= edge_ts - interval {within} and _{end}_ts <= edge_ts + interval {within}")
        out = out.join(side, (F.col(f"{end}_id") == F.col(f"_{end}")) & near, "left")
    unmet = F.array_compact(F.array(*(F.when(F.col(f"_{e}").isNull(), F.lit(e)) for e in ("source", "target"))))
    return out.select("id", "type", "source_id", "target_id", F.col("edge_ts").alias("ts"), F.when(F.size(unmet) == 0, "linked").otherwise("quarantined").alias("status"), unmet.alias("unmet"))
