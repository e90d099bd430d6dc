"""Documents from files and back: scans, filters, incremental ingest, JSONL sources and sinks.

Everything reads and writes through Spark, so any file system that Spark knows will do.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import content_hash, content_type, document_id
from ..plans.tables import numbered, settled

PROVENANCE = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "location", "fetchedAt", "sourceAuthority")])
ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("source", PROVENANCE),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("extractedAt", T.StringType()),
        T.StructField("data", T.VariantType()),
        T.StructField("metadata", T.VariantType()),
    ]
)


def glob_regex(pattern: str) -> str:
    """A regular expression for a path pattern: * within a folder, ** across, **/ none or more folders, ? one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" + pattern[i] if not pattern[i].isalnum() and pattern[i] not in "/_" else pattern[i]), i + 1
    return f"^{out}$"


def selected(rules: list[tuple[str, str, str]]) -> Column:
    """Whether a row's path is taken by (include or exclude, field, pattern); excludes win, no include takes all.

    Fields: path, name, extension; any other, such as tag, matches nothing.
    """
    name = F.element_at(F.split("path", "/"), -1)
    fields = {"path": F.col("path"), "name": name, "extension": F.regexp_extract(name, r"\.([^.]*)$", 1)}

    def hit(mode: str) -> Column:
        out = F.lit(False)
        for m, field, pattern in rules:
            if m == mode and field in fields:
                out = out | fields[field].rlike(glob_regex(pattern.lstrip(".") if field == "extension" else pattern))
        return out

    taken = hit("include") if any(m == "include" for m, _, _ in rules) else F.lit(True)
    return taken & ~hit("exclude")


def discover(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def scan_text(spark: SparkSession, root: str, rules: list[tuple[str, str, str]] = ()) -> DataFrame:
    """One document per Markdown or text file: id, path, name, content, content_type, hash, modified, length."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,markdown,txt,MD,TXT}").text(root, wholetext=True)
    rows = files.select(F.regexp_replace("_metadata.file_path", "^" + glob_regex(root.rstrip("/"))[1:-1] + "/?", "").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("length"))
    rows = rows.withColumn("path", F.regexp_replace("path", r"^file:/+", "/"))
    return rows.where(selected(list(rules))).withColumns({"hash": content_hash(F.col("content")), "content_type": content_type(F.col("path")), "id": document_id(F.lit("filesystem"), F.col("path"), content_hash(F.col("content")))})


def scan_json(spark: SparkSession, root: str) -> DataFrame:
    """One document per JSON file with its parsed content; malformed ones have status failed and no content."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    parsed = F.try_parse_json("value")
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), parsed.alias("structured"), F.when(parsed.isNull(), "failed").otherwise("fetched").alias("status"))


def scan_pages(spark: SparkSession, root: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """One Markdown document per file of pages, by a function from bytes to the text of each page; none: failed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "content")

    def convert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, content in f[["path", "content"]].itertuples(index=False, name=None):
                pages = [p.strip() for p in extract(bytes(content))]
                title = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                body = "\n\n".join([f"# {title}", *[f"## Page {i}\n\n{p}" for i, p in enumerate(pages, 1) if p]])
                rows.append((path, body if any(pages) else None, "fetched" if any(pages) else "failed"))
            yield pd.DataFrame(rows, columns=["path", "content", "status"])

    return files.mapInPandas(convert, "path string, content string, status string")


def incremental(found: DataFrame, checkpoint: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found with status fetched or skipped, next checkpoint) from path, modified, length, hash.

    Same time and size, or else the same content, is skipped.
    """
    old = checkpoint.select(F.col("path"), F.col("modified").alias("_m"), F.col("length").alias("_l"), F.col("hash").alias("_h"))
    same = (F.col("modified").eqNullSafe(F.col("_m")) & F.col("length").eqNullSafe(F.col("_l"))) | F.col("hash").eqNullSafe(F.col("_h"))
    known = F.coalesce(F.col("_h").isNotNull() & same, F.lit(False))
    status = found.join(old, "path", "left").withColumn("status", F.when(known, "skipped").otherwise("fetched")).drop("_m", "_l", "_h")
    kept = checkpoint.join(found.select("path"), "path", "left_anti").select("path", "modified", "length", "hash")
    return status, kept.unionByName(found.select("path", "modified", "length", "hash"))


def ingest_stats(rows: DataFrame) -> DataFrame:
    """fetched, skipped, failed, total."""
    return rows.agg(F.count_if(F.col("status") == "fetched").alias("fetched"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"), F.count(F.lit(1)).alias("total"))


class Connectors:
    """Sources by name; a name is taken once."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, scan: Callable[..., DataFrame]) -> None:
        if name in self._known:
            raise ValueError(f"already registered: {name}")
        self._known[name] = scan

    def get(self, name: str) -> Callable[..., DataFrame]:
        return self._known[name]

    def has(self, name: str) -> bool:
        return name in self._known

    def list(self) -> list[str]:
        return sorted(self._known)

    def sweep(self, spark: SparkSession, root: str) -> DataFrame:
        """All sources over one folder, as one table."""
        out = None
        for name in self.list():
            rows = self._known[name](spark, root).withColumn("source_type", F.lit(name))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out


def standard_connectors() -> Connectors:
    out = Connectors()
    out.register("filesystem", scan_text)
    out.register("json", scan_json)
    return out


def read_entries(spark: SparkSession, paths: list[str] | str, malformed: str = "skip") -> DataFrame:
    """JSONL entries; blank lines are none. Malformed lines are skipped, kept with _corrupt_record set ("mark"), or raise ("raise")."""
    if malformed == "raise":
        return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(paths)
    marked = spark.read.schema(T.StructType([*ENTRY.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(paths)
    return marked if malformed == "mark" else marked.where(F.col("id").isNotNull() | F.col("type").isNotNull() | F.col("data").isNotNull()).drop("_corrupt_record")


def read_run(spark: SparkSession, paths: list[str | None], malformed: str = "skip") -> DataFrame:
    """Entries of several files with their place (ord): file by file as given, then line by line; None is no file."""
    out = None
    for n, path in enumerate(p for p in paths if p is not None):
        rows = read_entries(spark, path, malformed).withColumn("ord", F.struct(F.lit(n).alias("file"), F.monotonically_increasing_id().alias("line")))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_authority(entries: DataFrame) -> DataFrame:
    """Entries whose source states no authority are operational."""
    return entries.withColumn("source", F.col("source").withField("sourceAuthority", F.coalesce("source.sourceAuthority", F.lit("operational"))))


def write_once(rows: DataFrame, path: str) -> None:
    """JSONL that is never written over."""
    rows.write.mode("errorifexists").json(path)


def manifest(spark: SparkSession, path: str, **facts) -> None:
    """One JSON row of a run's settings and figures."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def companion_names(docs: DataFrame) -> DataFrame:
    """docs with the name of a Markdown file for each, numbered where base names meet; no two get one name.

    A base name that is free is taken by its first document by path, the others are numbered from 2. Where such a number
    is another document's own name, the numbered one goes on behind its base name's last number until it is free.
    Numbers come from one order of all documents, so a base name of many documents is no task of its own.
    """
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    placed = numbered(docs.withColumn("_base", base), "_base", "path", name="_place")
    firsts = placed.groupBy("_base").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_last"))
    named = placed.join(firsts, "_base").withColumn("_n", F.col("_place") - F.col("_first") + 1)
    name = F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(F.lit("")), F.lit(".md"))
    while True:
        named = settled(named.withColumn("file", name), "companions")
        keeper = named.groupBy("file").agg(F.min(F.struct((F.col("_n") > 1).alias("later"), "_base", "_place")).alias("_keeper"), F.count(F.lit(1)).alias("_wanted")).where("_wanted > 1")
        if keeper.isEmpty():
            return named.drop("_base", "_place", "_first", "_last", "_n")
        judged = named.join(keeper.drop("_wanted"), "file", "left").withColumn("_lost", F.col("_keeper").isNotNull() & (F.col("_keeper._place") != F.col("_place")))
        moved = F.when(F.col("_lost"), F.col("_last") + F.row_number().over(Window.partitionBy("_base", "_lost").orderBy("_place"))).otherwise(F.col("_n"))
        judged = judged.withColumn("_n", moved).withColumn("_last", F.greatest("_last", F.max("_n").over(Window.partitionBy("_base"))))
        named = judged.drop("_keeper", "_lost", "file")


def write_companions(docs: DataFrame, folder: str) -> DataFrame:
    """path, file of the Markdown files that the tasks write for documents (path, content) in a folder all machines share.

    The names come from ``companion_names``, so a repeated task writes the same file again.
    """
    named = companion_names(docs).select("path", "file", F.coalesce("content", F.lit("")).alias("content"))
    os.makedirs(folder, exist_ok=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in f[["file", "content"]].itertuples(index=False, name=None):
                part = f"{folder}/.{name}.{os.getpid()}"
                with open(part, "w", encoding="utf-8") as out:
                    out.write(content)
                os.replace(part, f"{folder}/{name}")
            yield f[["path", "file"]]

    named.mapInPandas(write, "path string, file string").write.format("noop").mode("overwrite").save()
    return named.select("path", "file")


def dedupe_by_content(docs: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """hash, first id and number of the documents with the same content."""
    return docs.groupBy(content_hash(F.col(text)).alias("hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("n"))
