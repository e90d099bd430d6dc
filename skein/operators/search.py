"""Search: vectors by cosine, keywords by shared tokens, both by reciprocal ranks, and the plan of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_name


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length > 0, dot(a, b) / length).otherwise(F.lit(0.0))


def vector_top(vectors: DataFrame, query: list[float], k: int, key: str = "id", column: str = "embedding") -> DataFrame:
    """The k most similar rows: a scan and a top-k, no sort of all."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(column), q).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def keyword_top(rows: DataFrame, words: str, k: int, key: str = "id", column: str = "name") -> DataFrame:
    """The k rows that share most distinct query words."""
    wanted = F.array_distinct(F.split(normalise_name(F.lit(words)), " "))
    score = F.size(F.array_intersect(F.split(normalise_name(F.col(column)), " "), wanted))
    return rows.select(key, score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), key).limit(k)


def fused(rankings: list[DataFrame], k: int, key: str = "id", base: int = 60) -> DataFrame:
    """Reciprocal rank fusion of top lists (key, score), which are bounded by their own k."""
    ranked = None
    for r in rankings:
        one = r.select(key, F.row_number().over(Window.orderBy(F.col("score").desc(), key)).alias("rank"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.groupBy(key).agg(F.sum(1.0 / (base + F.col("rank"))).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def merged(rankings: list[DataFrame], how: str, k: int, key: str = "id") -> DataFrame:
    """key, score of several top lists: union (the best score), intersection (in all of them, the best score) or reciprocalRankFusion."""
    if how == "reciprocalRankFusion":
        return fused(rankings, k, key)
    if how not in ("union", "intersection"):
        raise ValueError(f"no such way to merge: {how}")
    both = None
    for i, r in enumerate(rankings):
        one = r.select(key, "score", F.lit(i).alias("_list"))
        both = one if both is None else both.unionByName(one)
    grouped = both.groupBy(key).agg(F.max("score").alias("score"), F.countDistinct("_list").alias("_lists"))
    kept = grouped.where(F.col("_lists") == len(rankings)) if how == "intersection" else grouped
    return kept.drop("_lists").orderBy(F.col("score").desc(), key).limit(k)


# Words that tell what a question is after.
INTENTS = [("impact", ["impact", "affect", "affected", "break", "breaks"]), ("pathFinding", ["path", "connect", "connected", "between"]), ("temporal", ["when", "changed", "history", "before", "since"]), ("facetedBrowse", ["many", "count", "number"]), ("typeListing", ["list", "all", "every"])]


def intent(question: str) -> str:
    """The kind of query a question asks for: the first intent one of whose words it has, else a hybrid search."""
    words = set("".join(c if c.isalnum() else " " for c in question.lower()).split())
    return next((kind for kind, marks in INTENTS if words & set(marks)), "hybrid")


def retrieved(question: str, rows: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """id, score, hop: what a question's answer may rest on, its best keyword hits and then their direct neighbours.

    Putting the answer into words is left to a model; rows: id, name; edges: source_id, target_id.
    """
    hits = keyword_top(rows, question, k).select("id", F.col("score").cast("double").alias("score"))
    both = edges.select("source_id", "target_id").union(edges.select("target_id", "source_id")).toDF("id", "other")
    near = both.join(F.broadcast(hits), "id").groupBy(F.col("other").alias("id")).agg((F.max("score") / 2).alias("score"))  # hits are k rows
    first = hits.withColumn("hop", F.lit(0)).unionByName(near.join(F.broadcast(hits.select("id")), "id", "left_anti").withColumn("hop", F.lit(1)))
    return first.orderBy(F.col("score").desc(), "hop", "id")


# The stores that answer each kind of query, what stands in for them, and how several are merged.
ROUTES = {
    "entityLookup": (["graph"], [], None),
    "typeListing": (["graph"], [], None),
    "traversal": (["graph"], [], None),
    "pathFinding": (["graph"], [], None),
    "impact": (["graph"], [], None),
    "semanticSearch": (["vector"], ["graph"], None),
    "facetedBrowse": (["postgresql"], [], None),
    "temporal": (["postgresql"], [], None),
    "fullText": (["postgresql"], [], None),
    "hybrid": (["vector", "graph"], [], "reciprocalRankFusion"),
}


def route(kind: str) -> dict:
    """The plan of a query; every store is a table here, so all are available."""
    if kind not in ROUTES:
        raise ValueError(f"no such kind of query: {kind}")
    stores, fallback, merge = ROUTES[kind]
    return {"kind": kind, "stores": stores, "fallback": fallback, "merge": merge}
