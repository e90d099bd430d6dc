"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space becomes one space. A
text is cut where its own content says so (after a sentence or clause end at least ``MIN_CHUNK``
characters on), so equal texts always have equal chunks. A chunk is named by hash and length; the
store of distinct chunks, through which each distinct chunk passes once, verifies that every name
stands for one content and numbers the contents of any name that does not. A document then is its
ordered list of verified identifiers (its recipe), and only recipes are compared and joined: a long
document's text is never moved again.

Cases: null text counts as empty, and empty texts are equal to each other; a text of white space
only is one space, not empty; rows that repeat a doc_id are all members of their group and all kept
if their doc_id is the smallest; null doc_ids never win against others; an empty table gives an
empty result; other columns are carried by ``kept_documents`` and ignored by ``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import SPACE, joined, table, written

MIN_CHUNK, MAX_CHUNK = 1024, 8192
#: Chunks of a recipe that may be broadcast (16 bytes each, at most ``MOST_HEAVY`` recipes).
SHORT = 64
#: A chunk runs to the first sentence or clause end, or common letter pair, after its least length.
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?:[.!?,;] |e t|n d)|.{{1,{MAX_CHUNK}}}"

RECIPE = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("variant", T.IntegerType())]))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _name(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else F.pmod(h, F.lit(1 << bits))


def _chunked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha (of the normalised text), chunks."""
    norm = docs.select(F.col(key), normalised(F.col(text)).alias("_norm"))
    return norm.select(F.col(key), F.sha2("_norm", 256).alias("text_sha256"), F.regexp_extract_all("_norm", F.lit(CHUNK), F.lit(0)).alias("_chunks"))


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """key, text_sha256, recipe: the ordered list of verified chunk identifiers.

    ``bits`` is the width of chunk names; tests narrow it so that names collide.
    """
    chunked = _chunked(docs, key, text)
    name = lambda c: F.struct(_name(c, bits).alias("h"), F.octet_length(c).alias("n"), F.lit(0).alias("variant"))
    named = written(chunked.select(key, "text_sha256", F.transform("_chunks", name).cast(RECIPE).alias("recipe")), "recipes")

    chunks = chunked.select("text_sha256", F.posexplode("_chunks").alias("pos", "chunk")).withColumns({"h": _name(F.col("chunk"), bits), "n": F.octet_length("chunk")})
    store = chunks.groupBy("h", "n", "chunk").agg(F.count(F.lit(1)).alias("uses"))
    ambiguous = store.groupBy("h", "n").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h", "n")
    ambiguous = written(ambiguous, "ambiguous")
    if ambiguous.isEmpty():
        return named
    # Some name has several contents: number them, and put the numbers into the recipes that use it.
    numbered = store.join(ambiguous, ["h", "n"], "left_semi").withColumn("variant", F.row_number().over(Window.partitionBy("h", "n").orderBy("chunk")))
    used = chunks.join(numbered.select("h", "n", "chunk", "variant"), ["h", "n", "chunk"]).select("text_sha256", "pos", "variant").distinct()
    fixes = used.groupBy("text_sha256").agg(F.map_from_entries(F.collect_list(F.struct("pos", "variant"))).alias("_fix"))
    verified = F.transform("recipe", lambda c, i: F.struct(c["h"].alias("h"), c["n"].alias("n"), F.coalesce(F.col("_fix")[i], F.lit(0)).alias("variant")))
    return named.join(fixes, "text_sha256", "left").select(key, "text_sha256", verified.cast(RECIPE).alias("recipe"))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 64) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256, n_chunks.

    Groups are counted with map-side aggregation, and only groups of several rows are joined back.
    """
    lists = recipes(docs, key, text, bits).withColumn("_digest", F.xxhash64("recipe"))
    groups = lists.groupBy("_digest", "recipe").agg(F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = written(groups, "groups")
    # long recipes of large groups are not broadcast, so their rows are not spread
    short = groups.where(F.size("recipe") <= SHORT)
    found = joined(lists, groups, ["_digest", "recipe"], short, "group_size", "left")
    keep = F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))
    return found.select(key, keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col(key).eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").alias("n_chunks"))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without later copies; rows that repeat the doc_id that stays all stay."""
    groups = exact_groups(docs, key, text)
    dropped = groups.where("not kept").select(F.col(key).alias("_key"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.col(key).alias("_id"), F.sha2(normalised(F.col(text)), 256).alias("_of"), F.struct(*docs.columns).alias("_row"))
    stay = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_sha")), "left_anti")
    return stay.select("_row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("n_chunks")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
