"""Quality classifier: histogram gradient-boosted trees over document statistics.

``features`` are counts and ratios of a whole text's bytes and words. ``fit`` grows trees of fixed
depth on binned features with the logistic loss; the model is a few flat arrays (split feature and
threshold of every inner node in heap order, value of every leaf), which ``score`` walks for all rows
at once, level by level. Labelled rows are used up to ``MAX_ROWS``, chosen by hash at any size.

Cases: null text counts as empty and is scored like it; unlabelled corpora give the score 0.5 and a
single label its own rate; null labels are not learnt from; repeated rows are scored alike; an empty
table gives an empty result; other columns are ignored, and carried by ``kept_documents``. A text is
measured whole and by itself: arrays of about 30 bytes per byte of it are held while it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, text_slices
from .minhash import WORD, Powers, word_hashes

#: Most labelled rows that the trees learn from.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, L2 = 60, 4, 64, 0.15, 10, 1.0
ACCEPT = 0.3

_CLASSES = ["lower", "upper", "digit", "space", "newline", "full stop", "comma", "!", "?", "|", "#$%&*@", "other ASCII", "beyond ASCII"]
_CLASS = np.full(256, 11, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 12
for _i, _chars in ((3, b" \t\x0b\x0c\r"), (4, b"\n"), (5, b"."), (6, b","), (7, b"!"), (8, b"?"), (9, b"|"), (10, b"#$%&*@")):
    _CLASS[list(_chars)] = _i
NAMES = [f"share of {c}" for c in _CLASSES] + ["log bytes", "log words", "mean word", "repeated words", "words as the one before", "capitalised words", "words that end in no letter"]


def features(offsets: np.ndarray, data: np.ndarray, powers: Powers) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    n, k = len(offsets) - 1, len(_CLASSES)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n) * k, sizes)
    counts = np.bincount(owner + _CLASS[data], minlength=n * k).reshape(n, k)
    hashes, bounds = word_hashes(offsets, data, powers)
    words = np.diff(bounds)
    whose = np.repeat(np.arange(n), words)
    some = np.maximum(words, 1)
    keys = np.sort((whose.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    distinct = np.bincount((keys[np.concatenate(([True], keys[1:] != keys[:-1]))] >> np.uint64(44)).astype(np.int64), minlength=n) if len(keys) else np.zeros(n)
    same = np.bincount(whose[1:][(hashes[1:] == hashes[:-1]) & (whose[1:] == whose[:-1])], minlength=n) if len(keys) else np.zeros(n)
    inside = WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) if len(data) else starts
    capital = np.bincount(whose[_CLASS[data[starts]] == 1], minlength=n)
    odd_end = np.bincount(whose[~np.isin(_CLASS[data[ends]], (0, 1, 12))], minlength=n)
    letters = counts.sum(1) - counts[:, 3] - counts[:, 4]
    rest = [np.log1p(sizes), np.log1p(words), letters / some, 1 - distinct / some, same / some, capital / some, odd_end / some]
    return np.column_stack([counts / np.maximum(sizes, 1)[:, None], *rest]).astype(np.float32)


@dataclass
class Trees:
    """Flat arrays: split and threshold [tree, inner node in heap order], leaf [tree, leaf]; start is the first logit."""

    start: float
    split: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        logit, row = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        for split, threshold, leaf in zip(self.split, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, split[node]] > threshold[node])
            logit += leaf[node - (leaf.size - 1)]
        return 1 / (1 + np.exp(-logit))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y (0 or 1)."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    splits, thresholds, values = [], [], []
    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])  # bin <= b means x <= edge b
        logit = np.full(len(y), start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-logit))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                at = node - first
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cell = at * BINS + bins[:, f]
                    sums = [np.bincount(cell, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None)]
                    (gl, hl, nl), (gt, ht, nt) = sums, [s[:, -1:] for s in sums]
                    gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                    gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
                    gain = gain[:, : len(e)]
                    b = gain.argmax(1)
                    better = gain[np.arange(width), b] > best + 1e-12
                    best = np.where(better, gain[np.arange(width), b], best)
                    split[first : first + width][better] = f
                    threshold[first : first + width][better] = e[b[better]]
                node = 2 * node + 1 + (x[np.arange(len(y)), split[node]] > threshold[node])
            at = node - inner
            value = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + L2)
            logit += value[at]
            splits.append(split), thresholds.append(threshold), values.append(value)
    n = len(values)
    return Trees(start, np.array(splits, np.int64).reshape(n, inner), np.array(thresholds).reshape(n, inner), np.array(values).reshape(n, leaves))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Trees:
    """A model from up to ``MAX_ROWS`` labelled rows that are not held out, those with the smallest hashes."""
    usable = labels.select(F.col(key), F.col(label).cast("int").alias("_label")).where(F.col("_label").isin(0, 1) & ~held_out(F.col(key))).distinct()
    chosen = usable.orderBy(F.xxhash64(key, "_label"), key, "_label").limit(MAX_ROWS)
    rows = docs.select(F.col(key), F.col(text).alias("text")).join(F.broadcast(chosen), key)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, offsets, data in text_slices(batch):
                x = features(offsets, data, powers)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), lists], ["key", "label", "x"])

    measured = rows.mapInArrow(measure, "key bigint, label int, x array<float>")
    # rows that repeat a labelled doc_id may be many, so the bound is set again
    got = measured.orderBy(F.xxhash64("key", "label", "x"), "key", "label").limit(MAX_ROWS).toPandas().sort_values(["key", "label"], kind="stable")
    x = np.array(got["x"].tolist(), np.float32).reshape(len(got), len(NAMES))
    return fit(x, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: Trees, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """key, score, predicted (1 from ``ACCEPT`` on), and the columns of ``carry``."""
    carry = carry or []
    chosen = docs.select(F.col(key), F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int{kinds}"

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, offsets, data in text_slices(batch, "_text"):
                p = model.score(features(offsets, data, powers))
                rest = [batch.column(2 + i).slice(a, b - a) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= ACCEPT).astype(np.int32)), *rest], [key, "score", "predicted", *carry])
        give_back()

    return chosen.mapInArrow(walk, schema)


def kept_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    model = train(docs, labels, key, text)
    wrapped = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    return scored(wrapped, model, "_key", "_text", ["_row"]).where("predicted = 1").select("_row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
