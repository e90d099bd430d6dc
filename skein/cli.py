"""The steps of a run from the command line: process, extract, normalise, classify-architecture.

``python -m skein.cli STEP ... --out FOLDER``; every step reads and writes tables through Spark, so each may be
run again by itself. Extraction and verdicts come from files that a model has written, or from a gateway that the
caller passes to the functions here.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import documents
from .operators import gates, mapping, resolution
from .sources import files


def process(spark: SparkSession, folder: str, out: str) -> dict[str, DataFrame]:
    """Documents of a folder as canonical JSONL, and their chunks."""
    docs = files.standard_connectors().sweep(spark, folder)
    files.write_once(docs.drop("structured"), f"{out}/documents")
    docs = spark.read.json(f"{out}/documents", schema="id string, path string, name string, content string, content_type string, source_type string")
    parts = documents.sections(docs.where("content_type = 'markdown'"), content=True)
    held = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("index", "title", "content"))).alias("_s"))
    cut = F.transform("_s", lambda x: F.struct(F.concat(F.lit("section-"), x["index"].cast("string")).alias("id"), x["title"].alias("title"), x["content"].alias("content")))
    ready = docs.join(held, "id", "left").select("id", F.col("name").alias("title"), "content", "content_type", cut.alias("sections"))
    files.write_once(documents.document_chunks(ready), f"{out}/chunks")
    return {"documents": docs, "chunks": spark.read.json(f"{out}/chunks")}


def extract(spark: SparkSession, entries: str, out: str, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Entries (JSONL) through the gates: nodes, edges, and the rows that did not pass with their reasons."""
    rows = files.with_authority(files.read_run(spark, [entries]))
    nodes = gates.emit_gate(mapping.entry_nodes(rows), threshold)
    edges = mapping.entry_edges(rows)
    judged = gates.edge_emit_gate(edges.where("problem is null").drop("problem"), nodes, threshold=threshold)
    plain = nodes.withColumn("data", F.to_json("data"))
    plain.where("status = 'emitted'").drop("status", "reason").write.mode("errorifexists").parquet(f"{out}/nodes")
    judged.where("status = 'emitted'").drop("status", "reason", "metadata").write.mode("errorifexists").parquet(f"{out}/edges")
    left = plain.where("status <> 'emitted'").select("id", "status", "reason")
    left = left.unionByName(judged.where("status <> 'emitted'").select("id", "status", "reason")).unionByName(edges.where("problem is not null").select("id", F.lit("failed").alias("status"), F.col("problem").alias("reason")))
    left.write.mode("errorifexists").json(f"{out}/excluded")
    return {"nodes": spark.read.parquet(f"{out}/nodes"), "edges": spark.read.parquet(f"{out}/edges"), "excluded": spark.read.json(f"{out}/excluded", schema="id string, status string, reason string")}


def normalise(spark: SparkSession, run: str, out: str) -> dict[str, DataFrame]:
    """Nodes and edges of a run after exact merges, and what was merged into what."""
    nodes, edges = spark.read.parquet(f"{run}/nodes"), spark.read.parquet(f"{run}/edges")
    entities = nodes.withColumn("ord", F.col("id"))
    survivors, remap = resolution.resolve_exact(entities)
    survivors.write.mode("errorifexists").parquet(f"{out}/nodes")
    resolution.remap_edges(edges, remap).write.mode("errorifexists").parquet(f"{out}/edges")
    remap.write.mode("errorifexists").parquet(f"{out}/remap")
    return {name: spark.read.parquet(f"{out}/{name}") for name in ("nodes", "edges", "remap")}


def classify_architecture(spark: SparkSession, run: str, verdicts: str, out: str, earlier: str | None = None) -> dict[str, DataFrame]:
    """Verdicts (JSONL: type, batch, name, disposition, rationale, ...) joined to the capabilities of a run, and those still without one."""
    raw = spark.read.parquet(f"{run}/nodes").where("type = 'BusinessCapability'").select("id", "type", "name")
    kind = "id string, subject string, disposition string, rationale string, level int, confidence double, assigned_parent string, rejection_reason string"
    kept = spark.read.schema(kind).json(earlier) if earlier else spark.createDataFrame([], kind)
    batches = resolution.classification_batches(raw, kept)
    said = spark.read.schema("batch int, name string, disposition string, rationale string, level int, confidence double, assigned_parent string, rejection_reason string").json(verdicts)
    named = resolution.verdict_subjects(said, batches).drop("batch", "name").withColumn("id", F.lit(None).cast("string"))
    new = resolution.valid_verdicts(named).select(*kept.columns)
    files.write_once(resolution.reclassified(kept, new, raw), f"{out}/classifications")
    done = spark.read.schema(kind).json(f"{out}/classifications")
    return {"classifications": done, "pending": batches.join(done.select(F.col("subject").alias("id")), "id", "left_anti")}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skein")
    steps = parser.add_subparsers(dest="step", required=True)
    for name, inputs in {"process": ["folder"], "extract": ["entries"], "normalise": ["run"], "classify-architecture": ["run", "verdicts"]}.items():
        step = steps.add_parser(name)
        for i in inputs:
            step.add_argument(i)
        step.add_argument("--out", required=True)
        if name == "extract":
            step.add_argument("--threshold", type=float, default=0.5)
        if name == "classify-architecture":
            step.add_argument("--earlier")
    args = vars(parser.parse_args(argv))
    run = {"process": process, "extract": extract, "normalise": normalise, "classify-architecture": classify_architecture}[args.pop("step")]
    for name, table in run(SparkSession.builder.getOrCreate(), **args).items():
        print(f"{name}: {table.count()} rows")


if __name__ == "__main__":
    main()
