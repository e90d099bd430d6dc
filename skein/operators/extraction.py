"""From chunks to entries: scripted or pluggable extraction, building entities and relationships, vectors to index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_filled, hashed_embedding, normalise_coverage, pseudo_embedding


def scripted(chunks: DataFrame, script: DataFrame) -> DataFrame:
    """chunks joined with the rows that a script (document, section, row) has for them: extraction without a model."""
    return chunks.join(script, ["document", "section"])


def extracted(chunks: DataFrame, gateway: Callable[[str], list[dict]], schema: T.StructType) -> DataFrame:
    """chunk id and the rows that a function from text to records finds in it; batches of chunks per call of a worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(chunk, *[r.get(n) for n in schema.names]) for chunk, text in f[["id", "content"]].itertuples(index=False, name=None) for r in gateway(text)]
            yield pd.DataFrame(rows, columns=["chunk", *schema.names])

    return chunks.select("id", "content").mapInPandas(run, T.StructType([T.StructField("chunk", T.StringType()), *schema.fields]))


def build_entities(raw: DataFrame) -> DataFrame:
    """raw rows (chunk, type, name, confidence, source, fetched_at, ...) with id, version, lifecycle_status and evidence."""
    evidence = F.array(F.struct(F.col("source"), F.col("chunk").alias("location"), F.col("fetched_at").alias("fetchedAt")))
    return raw.withColumns({"id": F.coalesce("id", F.sha2(F.to_json(F.struct("chunk", "type", "name")), 256)), "version": F.lit("1.0.0"), "lifecycle_status": F.coalesce("lifecycle_status", F.lit("active")), "evidence": evidence})


def build_relationships(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """raw relationships whose two different ends were found in the same chunk."""
    here = entities.select("chunk", "id").distinct()
    out = raw.where("source_id <> target_id")
    for end in ("source_id", "target_id"):
        out = out.join(here.withColumnRenamed("id", end), ["chunk", end], "left_semi")
    return out.select(*raw.columns)


def vector_rows(entries: DataFrame, dims: int = 16) -> DataFrame:
    """id, text, embedding of entries that are no relationships: name and description, or else the whole data as JSON."""
    words = F.trim(F.concat_ws(" ", "name", "description"))
    text = first_filled(words, F.col("data"))
    return entries.where("type <> 'Relationship'").select("id", text.alias("text")).withColumn("embedding", hashed_embedding(F.col("text"), dims))


def without_run(index: DataFrame, run_id: str) -> DataFrame:
    """An index without the vectors of a run."""
    return index.where(~F.col("run_id").eqNullSafe(F.lit(run_id)))


def last_write(index: DataFrame, rows: DataFrame) -> DataFrame:
    """A keyed index after writing rows (id, run_id, ...): the later write of an id wins."""
    return index.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def prompt(template: str, **columns: Column) -> Column:
    """A text column from a template with {names} of columns."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), F.coalesce(columns.get(name, F.col(name)).cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


class Prompts:
    """Templates by name and version; the highest version counts."""

    def __init__(self) -> None:
        self._known: dict[str, dict[tuple[int, ...], str]] = {}

    def add(self, name: str, version: str, template: str) -> None:
        self._known.setdefault(name, {})[tuple(map(int, version.split(".")))] = template

    def get(self, name: str, version: str | None = None) -> str:
        versions = self._known[name]
        return versions[tuple(map(int, version.split(".")))] if version else versions[max(versions)]


# --- seams, prompts and usage ------------------------------------------------------------------------------


class Normalisers:
    """What is done to the data of an entity of a type before it is built; types without an entry stay as they are."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, Column]] = {}

    def register(self, kind: str, **columns: Column) -> None:
        self._known[kind] = columns

    def apply(self, rows: DataFrame) -> DataFrame:
        for kind, columns in self._known.items():
            rows = rows.withColumns({name: F.when(F.col("type") == kind, c).otherwise(F.col(name)) for name, c in columns.items()})
        return rows


def standard_normalisers() -> Normalisers:
    """Coverage claims become one of the three levels where they can be read."""
    out = Normalisers()
    out.register("VendorCapabilityMapping", coverage=F.coalesce(normalise_coverage(F.col("coverage")), F.col("coverage")))
    return out


class FakeGateway:
    """A gateway without a model: answers by a function, vectors by ``pseudo_embedding``, and an account of what was used.

    ``extract`` adds answer, input_tokens and output_tokens to rows with a prompt; a quarter of a prompt's characters
    are its tokens, and an answer takes 16.
    """

    def __init__(self, router: Callable[[str], str] | None = None, dims: int = 8) -> None:
        self.router, self.dims = router or (lambda text: "{}"), dims

    def extract(self, rows: DataFrame, column: str = "prompt") -> DataFrame:
        router = self.router

        @F.pandas_udf("string")
        def answer(prompts: pd.Series) -> pd.Series:
            return prompts.map(lambda p: None if p is None else router(p))

        return rows.withColumns({"answer": answer(F.col(column)), "input_tokens": F.floor(F.length(column) / 4), "output_tokens": F.lit(16).cast("long")})

    def embed(self, rows: DataFrame, column: str = "text") -> DataFrame:
        return rows.withColumn("embedding", pseudo_embedding(F.col(column), self.dims))


def token_usage(calls: DataFrame) -> DataFrame:
    """calls, input_tokens, output_tokens in all."""
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"))


def provenance_block() -> Column:
    return F.concat(F.lit("[[doc:"), F.col("document"), F.lit("]] [[section:"), F.col("section_title"), F.lit("]]\nLocation: "), F.col("location"))


def entity_prompts(chunks: DataFrame, system: str, guidance: list[str]) -> DataFrame:
    """chunks with the prompt that asks for their entities; each piece of guidance comes once, in order."""
    once = list(dict.fromkeys(guidance))
    text = F.concat_ws("\n\n", F.lit(system), *map(F.lit, once), F.concat(F.lit("## Source\n"), provenance_block()), F.concat(F.lit("## Text\n"), F.col("content")))
    return chunks.withColumn("prompt", text)


def relationship_prompts(chunks: DataFrame, entities: DataFrame, system: str) -> DataFrame:
    """chunks with the prompt that asks for relationships among the entities (chunk, id, type, name) found in them."""
    line = F.concat(F.lit("- id="), F.col("_e.id"), F.lit(" type="), F.col("_e.type"), F.lit(" name="), F.col("_e.name"))
    found = entities.select("chunk", F.struct("id", "type", "name").alias("_e")).withColumn("_line", line)
    rosters = found.groupBy(F.col("chunk").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_e", "_line"))), lambda s: s["_line"]), "\n").alias("_roster"))
    roster = F.coalesce("_roster", F.lit("- (none found here)"))
    text = F.concat_ws("\n\n", F.lit(system), F.concat(F.lit("## Source\n"), provenance_block()), F.concat(F.lit("## Entities in scope\n"), roster), F.concat(F.lit("## Text\n"), F.col("content")))
    return chunks.join(rosters, "id", "left").withColumn("prompt", text).drop("_roster")


def name_prompts(batches: DataFrame, request: str) -> DataFrame:
    """batch, prompt: a request with the sorted names of each batch below, for adjudication or classification."""
    lines = F.transform(F.array_sort(F.collect_set("name")), lambda n: F.concat(F.lit("- "), n))
    return batches.groupBy("batch").agg(F.concat(F.lit(request + "\n\nNames:\n"), F.array_join(lines, "\n")).alias("prompt"))


def prompt_dump(entries: DataFrame, relationships: DataFrame, question: str) -> DataFrame:
    """line, by place: one self-contained text for any model, of a question and all entries and relationships as JSON.

    A table to be written by Spark in order; nothing is gathered.
    """
    spark = entries.sparkSession
    head = spark.createDataFrame([(0, "", f"QUESTION: {question}"), (1, "", "=== ENTRIES ==="), (3, "", "=== RELATIONSHIPS ===")], "part int, id string, line string")
    body = lambda rows, part: rows.select(F.lit(part).alias("part"), "id", F.to_json(F.struct(*rows.columns)).alias("line"))
    return head.unionByName(body(entries, 2)).unionByName(body(relationships, 4)).orderBy("part", "id")


def document_types(docs: DataFrame, rules: list[tuple[str, str]], other: str = "general") -> DataFrame:
    """docs with document_type: the first rule (type, pattern of the content) that fits."""
    kind = F.coalesce(*[F.when(F.col("content").rlike(pattern), F.lit(name)) for name, pattern in rules], F.lit(other))
    return docs.withColumn("document_type", kind)
