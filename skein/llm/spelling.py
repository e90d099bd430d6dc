"""Groups of spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word is cut in two even segments whose places depend on its length alone; one edit leaves one of them
whole. Words are indexed under (length, place, segment) and probed with the substrings of words of equal
length, and of words one code point longer, where the segment is as it is or shifted by one. Words that meet
under a key agree on all but a free stretch. Keys under which more than ``MEET`` words would meet are not
joined: their words' free stretch is cut in two even segments again, which must leave one whole as well, and
so on, down to a free stretch of one code point, where only real neighbours meet. So no key makes all pairs
of its words, whatever share of them it holds, and no pair is lost. Keys are hashes; each pair that meets is
verified on its words, and found pairs are deduplicated.

Words are counted in each task first, document by document, and only counts are shuffled. ``variants`` gives each
word the neighbour it is a variant of, if that is ``ratio`` times as frequent, and follows these forms to a
root. Counts grow by the ratio with every step, so the forms have no circles, and doubling the pointers
settles them in the logarithm of a chain's length.

Cases: null and wordless texts have no words; a missing doc_id counts as an empty one where runs are thinned;
rows that repeat a doc_id count as often as they come; words of any length take part; an empty table gives an
empty result; other columns are ignored. A text is held whole while its runs are counted.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, give_back, joined, table, text_slices, written

#: Letters of a run: A-Z, a-z and U+00C0 to U+00FF; A-Z are lower-cased before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Every so many runs by hash lose a code point; code points of a word and its occurrences at least; times as frequent as a form is.
THINNED, LEAST_LENGTH, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: Words that meet under one key at most before its free stretch is cut again.
MEET = 32
#: Words that a task holds with their counts before it passes them on.
HELD = 200_000


def counted_runs(doc_id: int | None, text: str, least: int = LEAST_LENGTH, thinned: int = THINNED) -> Counter:
    """Occurrences of each word of a lower-cased text; runs whose hash is due lose a code point."""
    lead = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in Counter(RUN.findall(text)).items():
        if len(run) < least:
            continue
        h = zlib.crc32(run.encode(), lead)
        if h % thinned == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        out[run] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of all words of at least ``least`` code points and ``least_count`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def passed(held: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, offsets, data in text_slices(batch, "text"):
                for at in range(a, b):
                    raw = data[offsets[at - a] : offsets[at - a + 1]].tobytes()
                    held.update(counted_runs(ids[at], raw.lower().decode("utf-8", "replace"), least))
                    if len(held) > HELD:
                        yield passed(held)
                        held = Counter()
        if held:
            yield passed(held)
        give_back()

    found = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, longer, length, low, high) with the hash of what their words have around the free stretch.

    length, low and high are the indexed words'; a longer word's free stretch has one code point more.
    """
    before, after = F.substr("word", F.lit(1), F.col("low")), F.expr("substr(word, high + 1 + cast(longer as int))")
    return rows.withColumn("key", F.xxhash64("length", "low", "high", before, after))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit is in the left or in the right half of its free stretch."""
    middle = (F.col("low") + F.floor((F.col("high") - F.col("low")) / 2)).cast("int")
    sides = F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "longer", "length", F.explode(sides).alias("_side")).select("word", "n", "longer", "length", "_side.low", "_side.high")


def _met(rows: DataFrame) -> DataFrame:
    """word, n, other, other_n: verified pairs of the words that meet under a key, each maybe several times."""
    left = rows.where("not longer").select("key", F.col("word").alias("word"), F.col("n").alias("n"))
    right = rows.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"), "longer")
    pairs = left.join(right, "key").where(F.col("longer") | (F.col("word") < F.col("other")))
    return pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, meet: int = MEET) -> DataFrame:
    """word, n, other, other_n: each pair of words (word, n) one edit apart once, in either order of the two.

    One round per cut of the free stretch, each written; a round takes the keys of the last one that too many words share.
    """
    length = F.length("word")
    roles = F.array(F.struct(F.lit(False).alias("longer"), length.alias("length")), F.struct(F.lit(True).alias("longer"), (length - 1).alias("length")))
    rows = words.select("word", "n", F.explode(roles).alias("_r")).select("word", "n", "_r.longer", "_r.length", F.lit(0).alias("low"), F.col("_r.length").alias("high")).where("length > 0")
    found, spent = None, []
    while True:
        rows = written(_keyed(_halved(rows)), "segments")
        spent.append(rows)
        shared = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("indexed"), F.count(F.lit(1)).alias("rows"), F.max(F.col("high") - F.col("low")).alias("free"))
        shared = written(shared.where("indexed > 0 and rows > 1"), "shared-segments")
        spent.append(shared)
        marked = written(joined(rows, shared.select("key", ((F.col("rows") > meet) & (F.col("free") > 1)).alias("again")), ["key"], shared, "rows"), "met-segments")
        spent.append(marked)
        pairs = written(_met(marked.where("not again")), "near-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        rows = marked.where("again").select("word", "n", "longer", "length", "low", "high")
        if rows.isEmpty():
            break
    out = written(found.dropDuplicates(["word", "other"]), "near-words")
    discarded(*spent)
    return out


def _order(n: Column, word: Column) -> Column:
    return F.struct((-n).alias("less"), word.alias("word"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of words (word, form): forms are followed to the last. Pointers double until none moves."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        stepped = written(now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        discarded(now)
        now = stepped
        if now.where("moved").isEmpty():
            return now.drop("moved")


def variants(words: DataFrame, ratio: int = RATIO, meet: int = MEET) -> DataFrame:
    """word, n, form, form_n, root, n_near of every word (word, n)."""
    pairs = near_pairs(words, meet)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(_order(F.col("other_n"), F.col("other"))).alias("_best"))
    ranked = words.join(best, "word", "left").withColumn("_ok", -F.col("_best.less") >= ratio * F.col("n"))
    formed = written(
        ranked.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_ok"), F.col("_best.word")).alias("form"), F.when(F.col("_ok"), -F.col("_best.less")).alias("form_n")), "forms"
    )
    followed = roots(formed.where("form is not null"))
    return formed.join(followed, "word", "left").select("word", "n", "form", "form_n", F.coalesce("root", "word").alias("root"), "n_near")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frequent words of all documents with the spelling that each is a variant of."""
    words = written(word_counts(table(spark, sf_dir, "documents")), "words")
    return variants(words)
