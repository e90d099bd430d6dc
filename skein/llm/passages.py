"""Removal of passages that an earlier document has: words covered by a window of words that starts in a smaller doc_id too.

Each window of ``depth`` words is filed under the least hashed piece of ``gram`` words in it, so equal windows are
filed alike, and neighbouring windows of a text mostly share their piece: such a run of windows is one row
(key, hash of the run's words, place), without its text. A key that one document alone has is dropped, since a window
of another document cannot be under it. Runs with the same words are aggregated to the smallest doc_id; the others
of them are repeats as a whole. Of different runs under one key one copy's bytes are fetched and sharded by key. Per
shard a compressed FM-index (``fmindex``) is built over the runs' words, all runs are streamed through it by backward
search, and places where the match reaches ``depth`` words of a smaller document are reported as intervals.

A key with more than ``HOT`` different runs is not sent to one shard: its windows (at most ``depth - gram + 1`` of a
run) are aggregated by a 128-bit digest of their words to the smallest doc_id instead, and its joins are salted.
A run is named by its key, two hashes of its words and their number: 192 bits of hash in all.

Cases: null and wordless texts have no words; texts of fewer than ``depth`` words are never touched; rows that repeat a
doc_id do not remove each other's words, and lose what a smaller doc_id has alike; a missing doc_id counts as larger
than any; windows are judged on the input, so what a removed passage removes elsewhere is removed too; an empty table
gives an empty result; other columns are ignored. Long texts are filed in stretches of ``STRETCH`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, give_back, joined, table, text_slices, written
from .fmindex import NONE, FmIndex
from .minhash import ORDER, Powers, mixed
from .repeats import SMALL_IDS, sliding_min

DEPTH, GRAM = 50, 8
#: Words of a shard's index, and different runs of a key from which its windows are aggregated one by one.
SHARD, HOT = 1 << 19, 2048
#: Bytes that are hashed together, and words of a long text that are filed together.
PIECE, STRETCH = 1 << 19, 1 << 18

_M = np.uint64
_BYTE = np.random.Generator(np.random.PCG64(12)).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = _M((1 << 20) - 1)


def hashed_words(data: np.ndarray, offsets: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash of each word, first word of each text and the end) of texts' bytes that lie one after the other."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of bounded length, cut between words
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE, "right")))
        low, high = starts[at], ends[to - 1]
        length = ends[at:to] - starts[at:to]
        place = np.arange(low, high) - np.repeat(starts[at:to], np.diff(np.append(starts[at:to], high)))
        up, _ = powers.upto(int(length.max()) + 1)
        values = np.where(inside[low:high], _BYTE[data[low:high]] * up[np.minimum(place, len(up) - 1)], _M(0))
        hashes[at:to] = mixed(np.add.reduceat(values, starts[at:to] - low) + length.astype(np.uint64))
        at = to
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def window_runs(hashes: np.ndarray, valid: np.ndarray, depth: int, gram: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(first window, windows, key, two hashes of the words) of each run among the valid window starts of some words."""
    if len(hashes) < depth or not valid.any():
        return (np.zeros(0, np.int64),) * 5
    grams = np.zeros(len(hashes) - gram + 1, np.uint64)
    for i in range(gram):
        grams += hashes[i : i + len(grams)] * ORDER[i]
    grams = mixed(grams)
    least = sliding_min((grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), depth - gram + 1)
    starts = np.flatnonzero(valid[: len(least)])
    anchor = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1))))
    n = np.diff(np.append(first, len(starts)))
    low = starts[first]
    up, down = powers.upto(len(hashes) + 1)
    names = []
    for values in (hashes, mixed(hashes ^ ORDER[51])):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(hashes)], dtype=np.uint64)))
        names.append(mixed((sums[low + n - 1 + depth] - sums[low]) * down[low] + n.astype(np.uint64) * ORDER[50]).view(np.int64))
    return low, n, grams[anchor[first]].view(np.int64), *names


_RUNS = "key bigint, content bigint, second bigint, doc bigint, th bigint, at int, n int, low int, stop int"


def all_runs(texts: DataFrame, depth: int, gram: int) -> DataFrame:
    """Runs of windows of all texts (doc, th, text): key, hashes, place in words (at) and windows, place in bytes (low, stop)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, _, offsets, data in text_slices(batch, "text", PIECE):
                starts, ends, hashes, bounds = hashed_words(data, offsets, powers)
                text_of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                for s in range(0, max(0, len(hashes) - depth + 1), STRETCH):
                    part = slice(s, s + STRETCH + depth - 1)
                    of = text_of[part]
                    valid = of[: max(0, len(of) - depth + 1)] == of[depth - 1 :]
                    low, n, key, content, second = window_runs(hashes[part], valid, depth, gram, powers)
                    low = low + s
                    text = text_of[low]
                    base, taken = offsets[text], pa.array(text + a)
                    columns = [pa.array(key), pa.array(content), pa.array(second), batch.column(0).take(taken), batch.column(1).take(taken)]
                    columns += [pa.array(x.astype(np.int32)) for x in (low - bounds[text], n, starts[low] - base, ends[low + n + depth - 2] - base)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "content", "second", "doc", "th", "at", "n", "low", "stop"])
        give_back()

    return texts.mapInArrow(find, _RUNS)


RUN = ["key", "content", "second", "n"]


def _chosen(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with their row of ``lists`` (doc, th, ...); few ids are broadcast first, so that only their texts move."""
    if lists.count() <= SMALL_IDS:
        texts = texts.join(F.broadcast(lists.select("doc", "th")), ["doc", "th"], "left_semi")
    return texts.join(lists, ["doc", "th"])


def _fetched(texts: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs (key, hashes, n, owner, kinds and a place) with their bytes."""
    lists = written(runs.groupBy("doc", "th").agg(F.collect_list(F.struct(*RUN, "owner", "kinds", "low", "stop")).alias("runs")), "places")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(0)[at].as_py().encode("utf-8", "surrogatepass")
                rows = [(*(r[c] for c in RUN), r["owner"], r["kinds"], data[r["low"] : r["stop"]]) for r in batch.column(1)[at].as_py()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [*RUN, "owner", "kinds", "bytes"])
        give_back()

    fetched = _chosen(texts, lists).select("text", "runs").mapInArrow(cut, "key bigint, content bigint, second bigint, n int, owner bigint, kinds bigint, bytes binary")
    return written(fetched.dropDuplicates(RUN), "bytes")


_HITS = "key bigint, content bigint, second bigint, n int, owner bigint, a int, b int"


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch of true values starts and ends."""
    edges = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def earlier_in(runs: list[bytes], windows: np.ndarray, owners: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, a, b): windows a to b (excluded) of runs that a run of a smaller owner has too, by an FM-index over all."""
    words = pa.array(b" ".join(runs).split(), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    lengths = windows + depth - 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    owner = np.repeat(owners, lengths)
    index = FmIndex(np.insert(words, offsets[1:], 0), np.repeat(owners, lengths + 1), depth)
    a, b = stretches(index.least_owners(words, offsets) < owner)
    run = np.searchsorted(offsets, a, "right") - 1
    return run, a - offsets[run], b - offsets[run]


def _searched(contents: DataFrame, words: int, depth: int) -> DataFrame:
    """Intervals of windows that a smaller owner's run in the same shard has."""
    shards = max(1, -(-words // SHARD))

    def search(shard: pa.Table) -> pa.Table:
        run, a, b = earlier_in(shard["bytes"].to_pylist(), shard["n"].to_numpy().astype(np.int64), shard["owner"].to_numpy(), depth)
        out = shard.select([*RUN, "owner"]).take(pa.array(run)).append_column("a", pa.array(a.astype(np.int32))).append_column("b", pa.array(b.astype(np.int32)))
        give_back()
        return out

    dealt = contents.select(*RUN, "owner", "bytes", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInArrow(search, _HITS)


def _aggregated(contents: DataFrame, depth: int) -> DataFrame:
    """Windows of hot keys' runs that a smaller owner's run under the key has: one row per window, by digest."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            at = at or {c: batch.schema.get_field_index(c) for c in (*RUN, "owner", "bytes")}
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                digests, rows, places = [], [], []
                for i, data in enumerate(part.column(at["bytes"]).to_pylist()):
                    words = data.split()
                    for j in range(len(words) - depth + 1):
                        digests.append(hashlib.blake2b(b" ".join(words[j : j + depth]), digest_size=16).digest())
                        rows.append(i)
                        places.append(j)
                taken = pa.array(rows, pa.int32())
                columns = [part.column(at[c]).take(taken) for c in (*RUN, "owner")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), pa.array(places, pa.int32())], [*RUN, "owner", "digest", "a"])
        give_back()

    windows = written(contents.mapInArrow(cut, "key bigint, content bigint, second bigint, n int, owner bigint, digest binary, a int"), "windows")
    least = written(windows.groupBy("key", "digest").agg(F.min("owner").alias("least"), F.max("owner").alias("most"), F.count(F.lit(1)).alias("rows")).where("least < most"), "least")
    found = joined(windows, least.select("key", "digest", "least"), ["key", "digest"], least, "rows")
    return found.where("least < owner").select(*RUN, "owner", "a", (F.col("a") + 1).alias("b"))


def earlier_spans(texts: DataFrame, depth: int = DEPTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc, th, spans: the window starts of each text (doc, th, text) whose words an earlier doc has in a window too."""
    runs = written(all_runs(texts, depth, gram), "runs")
    often = runs.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("rows"))
    often = written(often.where("least < most").select("key", "rows"), "often")
    some = written(joined(runs, often.select("key"), ["key"], often, "rows"), "shared-runs")
    place = F.min(F.struct("doc", "th", "at", "low", "stop"))
    contents = written(some.groupBy(*RUN).agg(place.alias("place"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("uses")).select(*RUN, "place.*", "most", "uses"), "contents")
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("doc").alias("least"), F.max("doc").alias("last")).where("least < last")
    several = written(several.select("key", "kinds"), "several")
    wanted = joined(contents.withColumn("owner", F.col("doc")), several, ["key"], several, "kinds")
    fetched = _fetched(texts, wanted)
    few = F.col("kinds") <= hot
    total, most = fetched.agg(F.sum(F.when(few, F.col("n") + depth)), F.max("kinds")).first()
    found = _searched(fetched.where(few), total or 0, depth)
    if (most or 0) > hot:
        found = found.unionByName(_aggregated(fetched.where(~few), depth))
    copies = contents.where("doc < most").select(*RUN, F.col("doc").alias("owner"), F.lit(0).alias("a"), F.col("n").alias("b"), F.lit(True).alias("later"))
    found = written(found.withColumn("later", F.lit(False)).unionByName(copies), "hits")
    placed = joined(some.select(*RUN, "doc", "th", "at"), found, RUN, contents, "uses").where(~F.col("later") | (F.col("doc") > F.col("owner")))
    spans = placed.select("doc", "th", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b")).distinct()
    out = written(spans.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    discarded(runs, often, some, contents, several, fetched, found)
    return out


def remaining(words: list[bytes], spans: list[tuple[int, int]], depth: int) -> list[bytes]:
    """Words outside of the windows that start in the spans (in order)."""
    kept, end = [], 0
    for a, b in spans:
        if a > end:
            kept += words[end:a]
        end = max(end, b - 1 + depth)
    return kept + words[end:]


def dedup_passages(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", hot: int = HOT, give_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_words, n_removed, kept_sha256, and the text left (words by single spaces) if asked for."""
    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(NONE))).alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).cast("long").alias("id"))
    spans = earlier_spans(texts.select("doc", "th", "text"), depth, gram, hot)
    names = [key, "n_words", "n_removed", "kept_sha256"] + ["kept"] * give_text
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.large_binary()][: len(names) - 1]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = t.encode("utf-8", "surrogatepass").split()
                    kept = remaining(words, [(x["a"], x["b"]) for x in s or []], depth)
                    left = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds))], names)
        give_back()

    ids = spans.select("doc", "th")
    marked = _chosen(texts, spans).select("id", "text", "spans")
    rest = texts.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, ["doc", "th"], "left_anti")
    untouched = rest.select("id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    schema = f"`{key}` bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * give_text
    return marked.unionByName(untouched).mapInArrow(cut, schema)


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 50-word windows that a smaller doc_id has."""
    return dedup_passages(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT h, min(doc_id) AS least FROM win GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN first USING (h) WHERE least < doc_id
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS rest, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d) ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
