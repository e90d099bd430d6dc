"""Removal of repeated passages: every byte covered by a ``depth``-byte string that starts anywhere else too.

Each ``depth``-byte string is filed under the least hashed ``GRAM``-byte piece in it, so equal strings
are filed alike. Neighbouring strings of a text mostly share their piece: a run of them is one row
(key, hash of the run's bytes, place, number of strings), about one per 80 bytes of text and without
its text. Keys that occur once have no repeats. Runs with equal bytes are repeats of each other as a
whole, and are counted, not moved. What is left are different runs under one key: of each, one copy's
bytes are fetched and sharded by key, and external induced sorting (``induced``) finds the strings
that occur in several of a shard's runs. A key with more than ``HOT`` different runs is not sent to
one shard: its runs are cut into sections of strings that have the piece at about the same offset, and
filed again under the bytes that all strings of a section share, so that a shard is about as small as
any other; sections become single strings where even that is not enough.

A run is named by its key, content hash and length: 128 bits of hash in all.

Cases: null text counts as empty; texts shorter than ``depth`` bytes are never touched; equal texts
lose everything; rows that repeat a doc_id are rows of their own with their own text; positions are
judged on the input, not on what is left; rows without doc_id are handled alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, joined, table, text_slices, written
from .induced import repeated_in
from .minhash import ORDER, Powers, mixed

DEPTH, GRAM = 200, 24
#: Bytes of runs in a shard, and memory of the sorter's queues before they go to disk.
SHARD, MEMORY = 6 << 20, 8 << 20
#: Different runs of a key from which its runs are cut into sections, and the offsets that a section covers at each level.
HOT, SECTIONS = 4096, (23, 1)
#: Ids up to this many are broadcast to pick texts; more are joined by shuffle.
SMALL_IDS = 500_000
#: Texts are cut into pieces of this many strings.
PIECE = 900_000

_M = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _M((1 << 20) - 1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each window, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    blocks = np.full(-(-len(values) // width) * width, _M(2**64 - 1))
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: np.ndarray, valid: np.ndarray, depth: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(first string, strings, key, hash of the bytes) of each run among the valid string starts of some bytes."""
    up, down = powers.upto(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)], dtype=np.uint64)))
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])
    places = np.arange(len(grams), dtype=np.uint64)
    least = sliding_min((grams & ~_PLACE) | places, depth - gram + 1)
    starts = np.flatnonzero(valid[: len(least)])
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    anchor = (least[starts] & _PLACE).astype(np.int64)
    new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)))
    first = np.flatnonzero(new)
    n = np.diff(np.concatenate((first, [len(starts)])))
    low = starts[first]
    content = mixed((sums[low + n - 1 + depth] - sums[low]) * down[low] + n.astype(np.uint64) * ORDER[50])
    return low, n, grams[anchor[first]].view(np.int64), content.view(np.int64)


def all_runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """key, content, doc, th, low, n of all runs; texts has doc, th (hash of the text) and text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()

        def row(batch, at, low, n, key, content):
            taken = pa.array(at)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(low, pa.int64()), pa.array(n, pa.int32())], ["key", "content", "doc", "th", "low", "n"])

        for batch in batches:
            for a, b, offsets, data in text_slices(batch, "text", 1 << 19):
                if b - a == 1 and len(data) > PIECE:
                    for p in range(0, len(data) - depth + 1, PIECE):
                        part = data[p : p + PIECE + depth - 1]
                        low, n, key, content = runs_of(part, np.ones(len(part) - depth + 1, bool), depth, gram, powers)
                        yield row(batch, np.full(len(low), a), low + p, n, key, content)
                    continue
                if len(data) < depth:
                    continue
                valid = np.ones(len(data), bool)
                tails = np.concatenate([np.arange(max(lo, hi - depth + 1), hi) for lo, hi in zip(offsets[:-1], offsets[1:], strict=True)])
                valid[tails] = False
                low, n, key, content = runs_of(data, valid, depth, gram, powers)
                owner = np.searchsorted(offsets, low, "right") - 1
                yield row(batch, owner + a, low - offsets[owner], n, key, content)
        give_back()

    return texts.mapInArrow(find, "key bigint, content bigint, doc bigint, th bigint, low bigint, n int")


def _chosen(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Inner join of texts with a table of lists per text; few ids are broadcast first, so that only their texts move."""
    ids = lists.select("doc", "th").distinct()
    if lists.count() <= SMALL_IDS:
        texts = texts.join(F.broadcast(ids), texts["doc"].eqNullSafe(ids["doc"]) & (texts["th"] == ids["th"]), "left_semi")
    named = lists.withColumnsRenamed({"doc": "_doc", "th": "_th"})
    return texts.join(named, texts["doc"].eqNullSafe(named["_doc"]) & (texts["th"] == named["_th"])).drop("_doc", "_th")


def _bytes_of(texts: DataFrame, runs: DataFrame, depth: int) -> DataFrame:
    """key, content, n, kinds, bytes of one copy of each run; runs has key, content, n, kinds and a place."""
    lists = written(runs.groupBy("doc", "th").agg(F.collect_list(F.struct("key", "content", "low", "n", "kinds")).alias("runs")), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_at, lists_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("runs")
            for at in range(batch.num_rows):
                data = batch.column(texts_at)[at].as_py().encode("utf-8", "surrogatepass")
                found = batch.column(lists_at)[at].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in found], pa.int64()), pa.array([r["content"] for r in found], pa.int64()), pa.array([r["n"] for r in found], pa.int32()), pa.array([r["kinds"] for r in found], pa.int64()), pa.array([data[r["low"] : r["low"] + r["n"] - 1 + depth] for r in found], pa.binary())],
                    ["key", "content", "n", "kinds", "bytes"],
                )
        give_back()

    return _chosen(texts, lists).select("text", "runs").mapInArrow(cut, "key bigint, content bigint, n int, kinds bigint, bytes binary").dropDuplicates(["key", "content", "n"])


def _spans(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def _sorted_hits(contents: DataFrame, total: int, depth: int) -> DataFrame:
    """key, content, n, a, b: strings a to b (excluded) of a run that occur in other runs of its shard too."""
    shards = max(1, -(-total // SHARD))

    def hits(pdf):
        flags = repeated_in(list(pdf["bytes"]), depth, MEMORY)
        rows = [(i, a, b) for i, f in enumerate(flags) if f.any() for a, b in zip(*_spans(f), strict=True)]
        at = [r[0] for r in rows]
        out = pdf[["key", "content", "n"]].iloc[at].reset_index(drop=True)
        give_back()
        return out.assign(a=np.array([r[1] for r in rows], np.int32), b=np.array([r[2] for r in rows], np.int32))

    dealt = contents.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(hits, "key bigint, content bigint, n int, a int, b int")


def anchor(data: bytes, depth: int, gram: int, powers: Powers) -> int:
    """Where the piece is that a run's strings are filed under."""
    raw = np.frombuffer(data, np.uint8)[:depth]
    up, down = powers.upto(depth + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
    grams = mixed((sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1])
    return int((grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)).argmin())


def _sections(contents: DataFrame, width: int, depth: int, gram: int) -> DataFrame:
    """key, content, n, low, sub, m, bytes: sections of runs; sub is the hash of what all strings of a section share.

    Equal strings have the piece at the same offset, so they are in sections with the same sub.
    """

    def cut(frames):
        import pandas as pd  # only in tasks that need it: workers of other stages stay smaller

        powers = Powers()
        for f in frames:
            rows = []
            for key, content, n, data in f[["key", "content", "n", "bytes"]].itertuples(index=False, name=None):
                p = anchor(data, depth, gram, powers)
                for first in range(0, depth - gram + 1, width):
                    last = min(first + width - 1, depth - gram)
                    low, high = max(0, p - last), min(n - 1, p - first)
                    if low <= high:
                        shared = hashlib.blake2b(data[p - first : p - last + depth], digest_size=8, salt=first.to_bytes(2, "little")).digest()
                        rows.append((key, content, n, low, int.from_bytes(shared, "little", signed=True), high - low + 1, data[low : high + depth]))
            yield pd.DataFrame(rows, columns=["key", "content", "n", "low", "sub", "m", "bytes"])

    return contents.mapInPandas(cut, "key bigint, content bigint, n int, low int, sub bigint, m int, bytes binary")


def _hits(contents: DataFrame, depth: int, gram: int, hot: int, widths: tuple[int, ...]) -> DataFrame:
    """key, content, n, a, b: strings of runs that occur in other runs of their key.

    contents: key, content, n, kinds (how many runs the key has, above 1), bytes, each run once.
    """
    few = F.lit(True) if not widths else F.col("kinds") <= hot
    total, many = contents.agg(F.sum(F.when(few, F.col("n") + depth)), F.max("kinds")).first()
    found = _sorted_hits(contents.where(few).select("key", "content", "n", "bytes"), total or 0, depth)
    if not widths or (many or 0) <= hot:
        return found
    parts = _sections(contents.where(~few), widths[0], depth, gram)
    parts = written(parts.withColumn("part", F.xxhash64("bytes")), "sections")
    once = parts.groupBy("sub", "part", "m").agg(F.count(F.lit(1)).alias("uses"), F.first("bytes").alias("bytes"))
    once = written(once.select(F.col("sub").alias("key"), F.col("part").alias("content"), F.col("m").alias("n"), "uses", "bytes"), "sections-once")
    several = once.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    deeper = _hits(written(once.drop("uses").join(several, "key"), "sections-several"), depth, gram, hot, widths[1:])
    whole = once.where("uses > 1").select("key", "content", "n", F.lit(0).alias("a"), F.col("n").alias("b"))
    names = {"key": "sub", "content": "part", "n": "m"}
    back = written(whole.unionByName(deeper), "section-hits").withColumnsRenamed(names)
    placed = joined(parts.drop("bytes"), back, ["sub", "part", "m"], once.withColumnsRenamed(names), "uses")
    return found.unionByName(placed.select("key", "content", "n", (F.col("low") + F.col("a")).alias("a"), (F.col("low") + F.col("b")).alias("b")))


def repeated_spans(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts: doc, th, text; spans: doc, th, spans of string starts) of all rows, and of those with repeats."""
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = written(all_runs(texts, depth, gram), "runs")
    often = written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "often")
    some = written(joined(runs, often.select("key"), ["key"], often, "rows"), "shared-runs")
    order = F.xxhash64("doc", "th", "low")
    contents = some.groupBy("key", "content", "n").agg(F.count(F.lit(1)).alias("uses"), F.min_by("doc", order).alias("doc"), F.min_by("th", order).alias("th"), F.min_by("low", order).alias("low"))
    contents = written(contents, "contents")
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    found = contents.where("uses > 1").select("key", "content", "n", F.lit(0).alias("a"), F.col("n").alias("b"))
    fetched = written(_bytes_of(texts, contents.join(several, "key"), depth), "bytes")
    if not fetched.isEmpty():
        found = found.unionByName(_hits(fetched, depth, gram, hot, SECTIONS))
    found = written(found, "hits")
    placed = joined(some, found, ["key", "content", "n"], contents, "uses").select("doc", "th", (F.col("low") + F.col("a")).alias("a"), (F.col("low") + F.col("b")).alias("b"))
    spans = placed.distinct().groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    return texts, written(spans, "spans")


def removed(data: bytes, spans: list[tuple[int, int]], depth: int) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed stretches); spans of string starts are in order."""
    left, cut, count, end = [], 0, 0, 0
    for a, b in spans:
        stop = b - 1 + depth
        if a > end or not count:
            left.append(data[end:a])
            count += 1
            end = a
        if stop > end:
            cut += stop - end
            end = stop
    left.append(data[end:])
    return b"".join(left), cut, count


def dedup_passages(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int = HOT, give_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, and the bytes left if asked for."""
    texts, spans = repeated_spans(docs, depth, gram, key, text, hot)
    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * give_text
    schema = f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * give_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data = t.encode("utf-8", "surrogatepass")
                    kept, gone, count = removed(data, [(x["a"], x["b"]) for x in s or []], depth)
                    rows.append((len(data), gone, count, hashlib.sha256(kept).hexdigest(), kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names) - 1))], names)

    few = spans.count() <= SMALL_IDS
    marked = _chosen(texts, spans).select("doc", "text", "spans")
    ids = spans.select(F.col("doc").alias("_doc"), F.col("th").alias("_th"))
    rest = texts.join(F.broadcast(ids) if few else ids, texts["doc"].eqNullSafe(F.col("_doc")) & (texts["th"] == F.col("_th")), "left_anti")
    untouched = rest.select("doc", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    return marked.unionByName(untouched).mapInArrow(cut, schema)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that occur more than once."""
    return dedup_passages(table(spark, sf_dir, "documents"))
