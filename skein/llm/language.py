"""Language identification by the nearest of several centroids per language.

A text is the TF-IDF vector of its hashed byte bigrams and trigrams (case folded, everything but
letters a gap), normalised to length 1. Spherical k-means gives each language ``CENTROIDS``
centroids. A text takes the language of the centroid with the largest cosine; it is ``rejected``
when it is further from that centroid than nearly all of the texts the centroid was learnt from.
Learning uses up to ``MAX_ROWS`` labelled rows in all, evenly by language and chosen by hash.

Cases: null texts and texts without a letter are ``und`` with score 0; ``und`` as well where nothing
could be learnt; rows without a language are predicted but not learnt from; equal texts get equal
predictions; ties go to the first language by code point; an empty table gives an empty result. A
text is counted whole: arrays of about 40 bytes per byte of the longest one are held while it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import table, text_slices

#: Most labelled rows that the centroids are learnt from, all languages together.
MAX_ROWS = 2400
CENTROIDS, SWEEPS = 4, 12
DIMS = 4096
#: Share of the texts behind a centroid that its rejection distance covers.
COVERED = 0.995
SHARPNESS = 25.0
NONE = "und"

_FOLD = np.zeros(256, np.uint16)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def vectors(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Counts of hashed bigrams and trigrams, a row for each text."""
    n = len(offsets) - 1
    folded = _FOLD[data]
    if len(data) > 1:  # capital Latin-1 letters, as UTF-8
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        folded[1:][capital] += 0x20
    owner = np.repeat((np.arange(n) * DIMS).astype(np.int64), np.diff(offsets))
    total = np.zeros(n * DIMS, np.int64)
    if len(data) > 1:
        wide = folded.astype(np.uint32)
        two = (wide[:-1] << np.uint32(8)) | wide[1:]
        same = (owner[1:] == owner[:-1]) & (two != 0)
        hashed = (two * np.uint32(2654435761)) >> np.uint32(20)
        total += np.bincount(owner[1:][same] + hashed[same], minlength=n * DIMS)
        if len(data) > 2:
            three = ((two[:-1] << np.uint32(8)) | wide[2:]) ^ np.uint32(0x5BD1E995)
            same = (owner[2:] == owner[:-2]) & (wide[1:-1] != 0)
            hashed = (three * np.uint32(2246822519)) >> np.uint32(20)
            total += np.bincount(owner[2:][same] + hashed[same], minlength=n * DIMS)
    return total.reshape(n, DIMS)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


def has_letter(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122)
    run = np.concatenate(([0], np.cumsum(ascii_letter)))
    out = run[offsets[1:]] > run[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


@dataclass
class Centroids:
    languages: list[str]
    idf: np.ndarray
    centres: np.ndarray
    whose: np.ndarray
    least: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the language, score, rejected) of each row of counts."""
        cosine = weighed(counts, self.idf) @ self.centres.T
        near = cosine.argmax(1)
        best = np.full((len(counts), len(self.languages)), -1.0)
        for k in range(len(self.languages)):
            best[:, k] = cosine[:, self.whose == k].max(1)
        odds = np.exp(SHARPNESS * (best - best.max(1, keepdims=True)))
        pick = best.argmax(1)
        score = odds[np.arange(len(counts)), pick] / odds.sum(1)
        return pick, score, cosine[np.arange(len(counts)), near] < self.least[near]


def cluster(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(unit centres, cosine floor of each) by spherical k-means from evenly spread first centres."""
    first = [0]
    nearest = x @ x[0]
    while len(first) < min(k, len(x)):
        first.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[first[-1]])
    centres = x[first].copy()
    for _ in range(SWEEPS):
        to = (x @ centres.T).argmax(1)
        for j in range(len(centres)):
            if (to == j).any():
                mean = x[to == j].mean(0)
                centres[j] = mean / max(np.linalg.norm(mean), 1e-9)
    cosine = x @ centres.T
    to = cosine.argmax(1)
    floor = np.array([np.quantile(cosine[to == j, j], 1 - COVERED) if (to == j).any() else 0.0 for j in range(len(centres))])
    return centres, floor


def fit(counts: np.ndarray, languages: list[str]) -> Centroids:
    names = sorted(set(languages))
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.1
    x = weighed(counts, idf)
    centres, floors, whose = [], [], []
    for k, name in enumerate(names):
        c, f = cluster(x[np.array([lang == name for lang in languages])], CENTROIDS)
        centres.append(c), floors.append(f)
        whose += [k] * len(c)
    return Centroids(names, idf, np.concatenate(centres), np.array(whose), np.concatenate(floors))


def held_out(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(4)) == 2


def _counted(docs: DataFrame, names: list[str], schema: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_slices(batch, "text", 1 << 19, 256):
                x = vectors(offsets, data).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * DIMS), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(names))), lists], [*names, "x"])

    return docs.mapInArrow(count, schema)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Centroids | None:
    """Centroids from rows that are not held out and have a language and a letter; None if there are none."""
    usable = docs.select(F.col(key).cast("long").alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).where(~held_out(F.col(key)) & F.col("lang").isNotNull() & (F.length("text") > 0))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")).orderBy("lang").limit(MAX_ROWS)
    each = max(1, MAX_ROWS // max(1, sizes.count()))
    shares = sizes.select("lang", (each / F.col("rows")).alias("share"))
    # a hash of the whole row, as a number from 0 to 1; rows that repeat count once
    place = F.xxhash64("key", "lang", "text") / F.lit(2.0**64) + 0.5
    near = usable.join(F.broadcast(shares), "lang").withColumn("place", place).where("place < 2 * share")
    once = near.groupBy("lang", "place").agg(F.min("key").alias("key"), F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = once.withColumn("rank", rank).where(F.col("rank") <= each).limit(MAX_ROWS)
    got = _counted(chosen.select("key", "lang", "text"), ["key", "lang"], "key bigint, lang string, x array<int>").toArrow().sort_by([("key", "ascending"), ("lang", "ascending")])
    if not got.num_rows:
        return None
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    some = x.sum(1) > 0
    return fit(x[some], [name for name, ok in zip(got.column("lang").to_pylist(), some, strict=True) if ok]) if some.any() else None


def identified(docs: DataFrame, model: Centroids | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, rejected."""
    chosen = docs.select(F.col(key), F.col(text).alias("text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double, rejected boolean"

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, offsets, data in text_slices(batch, "text", 1 << 19, 256):
                letters = has_letter(offsets, data)
                names, score, rejected = [NONE] * (b - a), np.zeros(b - a), ~letters
                if model is not None:
                    pick, score, far = model.predict(vectors(offsets, data))
                    names = [model.languages[k] if ok else NONE for k, ok in zip(pick, letters, strict=True)]
                    score, rejected = np.where(letters, score, 0.0), rejected | far
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], [key, "lang_pred", "score", "rejected"])

    return chosen.mapInArrow(predict, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return identified(docs, train(docs)).withColumn("held_out", held_out(F.col("doc_id")))
