"""Keyword search by BM25 over an inverted index with maxima of blocks.

Documents are dealt in chunks of ``CHUNK`` ids in their order. Their words are counted where they are read and move once, to
the task of their chunk, so no other copy of the texts is kept. A block holds a word's postings in a chunk, so the commonest
word has as many blocks as there are chunks and none is larger than a chunk. Postings are written by bucket of the
word's hash: a search reads the buckets of its words, and of these the blocks it needs. A small table has each
block's largest weight. As chunks are the same for all words, the weights' sum over a query's words bounds what any
document of a chunk can score: the chunk that promises most is scored first, its k-th score is a threshold, and chunks
that promise less are never read. Blocks and queries of a chunk meet in one task, which adds up the scores; only documents
that reach the threshold leave it. The results are those of scoring everything.

Cases: null texts have no words; rows with one id are one document in the results, whose rows of equal length count as one text; words of a query count once; unknown words say nothing; a query without known words has
no results; documents with equal scores come in order of their id.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.tables import numbered, settled

CHUNK, BUCKETS = 4096, 64
#: Saturation of repeated words, and how much a document's length counts.
K1, B = 1.2, 0.75
#: Words of all queries up to which they are written into the filter of the scan.
FEW_WORDS = 500
#: Digits that scores are rounded to, so that the order of additions does not show.
DIGITS = 6


def words_of(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _weight(average: float) -> Callable:
    """What a word's occurrences (tf) add to the score of a document of some length, before the word's own weight; for columns or arrays."""
    return lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _counting() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents' numbers of words, their words, each once, and how often each occurs."""

    def run(batches):
        found = re.compile(b"[a-z0-9]+").findall
        for batch in batches:
            words, times = [], [pa.array([], pa.int32())]
            for text in batch["text"]:
                own = Counter(found(text.as_py()))
                words.append(b" ".join(own))
                times.append(pa.array(own.values(), pa.int32()))
            total = pa.array([int(t.to_numpy().sum()) for t in times[1:]], pa.int32())
            listed = pa.ListArray.from_arrays(pa.array(np.cumsum([*map(len, times)]), pa.int32()), pa.concat_arrays(times))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["chunk"], total, pa.array(words, pa.binary()), listed], ["doc", "chunk", "length", "words", "times"])

    return run


def _added(average: float) -> Callable[[pa.Table], pa.Table]:
    """Adds up a chunk's scores of each query; documents whose sum can't reach the query's ``least`` are left out."""
    weigh = _weight(average)

    def add(rows: pa.Table) -> pa.Table:
        blocks, asked = rows.filter(pc.is_null(rows["idf"])), rows.filter(pc.is_valid(rows["idf"]))
        postings = blocks["postings"].combine_chunks()
        flat, ends = postings.flatten(), np.cumsum(pc.list_value_length(postings).to_numpy(zero_copy_only=False))
        docs = flat.field("doc").dictionary_encode("encode")
        place, weight = docs.indices.to_numpy(), weigh(flat.field("tf").to_numpy().astype(float), flat.field("length").to_numpy().astype(float))
        asked = asked.append_column("block", pc.index_in(asked["word"], value_set=blocks["word"].combine_chunks()))
        asked = asked.filter(pc.is_valid(asked["block"]))
        names = asked["query"].combine_chunks().dictionary_encode("encode")
        query, block, idf, least = names.indices.to_numpy(), asked["block"].to_numpy(), asked["idf"].to_numpy(), asked["least"].to_numpy()
        order = np.argsort(query, kind="stable")
        found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for own in np.split(order, np.flatnonzero(np.diff(query[order])) + 1) if len(order) else []:
            parts = [slice(ends[b - 1] if b else 0, ends[b]) for b in block[own]]
            sums = np.bincount(np.concatenate([place[p] for p in parts]), np.concatenate([weight[p] * i for p, i in zip(parts, idf[own], strict=True)]), len(docs.dictionary))
            some = np.flatnonzero((sums > 0) & (sums + 10.0**-DIGITS >= least[own[0]]))
            found.append((np.full(len(some), query[own[0]]), some, sums[some]))
        of, which, score = map(np.concatenate, zip(*found, strict=True))
        chunk = pa.array(np.full(len(of), rows["chunk"][0].as_py()), pa.int32())
        return pa.table({"query": names.dictionary.take(pa.array(of)), "chunk": chunk, "doc": docs.dictionary.take(pa.array(which)), "score": score})

    return add


def _numbers_up_to(bounds: Column, value: Column, size: int) -> Column:
    """How many of at most ``size`` sorted bounds do not exceed a value, by halving; none for null."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, size.bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) <= value, at + step).otherwise(at))


def build(docs: DataFrame, folder: str, key: str = "id", text: str = "content", chunk: int = CHUNK, buckets: int = BUCKETS) -> None:
    """Write the index of documents to a folder: postings, block maxima, words, and figures of the whole."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    ids = settled(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(words_of(F.col("text")))).alias("words")), "ids")
    whole = ids.agg(F.sum("n").alias("documents"), (F.sum("words") / F.sum("n")).alias("average"), F.max("n").alias("most"), F.count(F.lit(1)).alias("ids")).first()
    documents, average = whole["documents"] or 0, whole["average"] or 1.0
    spark.createDataFrame([(json.dumps({"documents": documents, "average": average, "buckets": buckets}),)], "value string").coalesce(1).write.text(f"{folder}/figures")
    # one id a chunk; nulls are in the first
    bounds = numbered(ids.select("doc"), "doc", name="_n").where((F.col("_n") % chunk == 0) & (F.col("_n") > 0)).agg(F.sort_array(F.collect_list("doc")).alias("_bounds"))
    placed = docs.crossJoin(F.broadcast(bounds)).select("doc", _numbers_up_to(F.col("_bounds"), F.col("doc"), whole["ids"] // chunk).alias("chunk"), F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    kind = T.StructType([placed.schema["doc"], placed.schema["chunk"], T.StructField("length", T.IntegerType()), T.StructField("words", T.BinaryType()), T.StructField("times", T.ArrayType(T.IntegerType()))])
    # words move once, to the task of their chunk; all that follows stays there
    split = placed.mapInArrow(_counting(), kind).where("length > 0").repartition("chunk").withColumn("words", F.split(F.col("words").cast("string"), " "))
    counted = split.select("doc", "chunk", "length", F.inline(F.arrays_zip("words", "times"))).select("doc", "chunk", "length", F.col("words").alias("word"), F.col("times").alias("tf"))
    if (whole["most"] or 0) > 1:  # rows with one id and length count as one document
        counted = counted.groupBy("chunk", "word", "doc", "length").agg(F.sum("tf").cast("int").alias("tf"))
    blocks = counted.groupBy("chunk", "word").agg(F.max(_weight(average)(F.col("tf"), F.col("length"))).alias("most"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("doc", "tf", "length"))).alias("postings"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
    blocks.withColumn("bucket", bucket).sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{folder}/postings")
    held = spark.read.parquet(f"{folder}/postings")
    held.select("word", "chunk", "most", "n", "bucket").repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{folder}/maxima")


class TextIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.figures = json.loads(spark.read.text(f"{folder}/figures").first()[0])

    def _of_words(self, table: str, words: DataFrame) -> DataFrame:
        """Rows of a table for some words (bucket, word); few words go into the scan's filter, buckets always do."""
        rows = self.spark.read.parquet(f"{self.folder}/{table}")
        buckets = [r[0] for r in words.select("bucket").distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets))
        few = [r[0] for r in words.select("word").distinct().limit(FEW_WORDS + 1).collect()]
        if len(few) <= FEW_WORDS:
            rows = rows.where(F.col("word").isin(few))
        return rows.drop("bucket")

    def _scored(self, wanted: DataFrame, words: DataFrame) -> DataFrame:
        """query, chunk, doc, score of the documents that reach ``least`` in some chunks (query, chunk, least) of queries' words (query, word, idf)."""
        chunks = F.broadcast(wanted.select("chunk").distinct())  # one row a chunk at most
        postings = self._of_words("postings", words).join(chunks, "chunk", "left_semi").join(words.select("word").distinct(), "word", "left_semi").select("chunk", "word", "postings")
        asked = wanted.join(words.select("query", "word", "idf"), "query").select("chunk", "word", "query", "idf", "least")
        # a chunk's blocks and questions meet in one task, and its scores are added up there
        both = postings.unionByName(asked, allowMissingColumns=True)
        doc = postings.schema["postings"].dataType.elementType["doc"].dataType
        schema = T.StructType([T.StructField("query", words.schema["query"].dataType), T.StructField("chunk", T.IntegerType()), T.StructField("doc", doc), T.StructField("score", T.DoubleType())])
        return both.groupBy("chunk").applyInArrow(_added(self.figures["average"]), schema).withColumn("score", F.round("score", DIGITS))

    def _best(self, wanted: DataFrame, words: DataFrame, k: int) -> DataFrame:
        """The k best documents of each query in each of its wanted chunks."""
        place = F.row_number().over(Window.partitionBy("query", "chunk").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        return self._scored(wanted, words).withColumn("place", place).where(F.col("place") <= k).select("query", "doc", "score")

    def search(self, queries: DataFrame, k: int = 10, key: str = "id", text: str = "text") -> DataFrame:
        """query, doc, score, place of the k best documents of each query."""
        bucket = F.pmod(F.xxhash64("word"), F.lit(self.figures["buckets"])).cast("int")
        words = settled(queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(words_of(F.col(text)))).alias("word")).withColumn("bucket", bucket), "query-words")
        maxima = settled(self._of_words("maxima", words).join(words.select("word").distinct(), "word"), "maxima")
        n = F.lit(float(self.figures["documents"]))
        known = maxima.groupBy("word").agg(F.sum("n").alias("df")).select("word", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        words = settled(words.join(known, "word"), "weighed-words")
        bounds = maxima.join(words, "word").groupBy("query", "chunk").agg(F.sum(F.col("idf") * F.col("most")).alias("bound"))
        bounds = settled(bounds, "bounds")
        best = bounds.groupBy("query").agg(F.max_by("chunk", F.struct("bound", "chunk")).alias("chunk"))
        first = settled(self._best(best.withColumn("least", F.lit(0.0)), words, k), "first-scores")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last()))
        least = first.withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("least"))
        # a bound may lie below a rounded score by half a digit
        rest = bounds.join(best.withColumnRenamed("chunk", "_done"), "query").join(least, "query", "left").where((F.col("chunk") != F.col("_done")) & (F.col("bound") + 10.0**-DIGITS >= F.coalesce("least", F.lit(0.0))))
        found = first.unionByName(self._best(settled(rest.select("query", "chunk", F.coalesce("least", F.lit(0.0)).alias("least")), "chunks"), words, k))
        return found.withColumn("place", place).where(F.col("place") <= k).select("query", "doc", "score", "place")
