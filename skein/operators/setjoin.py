"""Exact similarity join of token sets that keeps little on disk.

Token sets are never stored for all rows: names are split again in each of three passes, and what passes between them is
small. The first gives a digest of each set, the second the prefix that can meet others and a signature of some bits a
token, the third the whole sets of those rows alone whose signatures left a pair standing.

Rows meet at keys. A rare token is a key itself. Pairs that share fewer than ``TOGETHER`` rare tokens share many frequent
ones: these are dealt in groups by their hash, and two of one group make a key, so a word that a third of all texts use
brings no two of them together by itself. As more tokens are shared than there are groups, some groups have two of them.

Tokens are ordered by how often they are used. Any order that all rows share finds every pair, so uses are counted in
``COUNTERS`` buckets of the token's hash, a table of fixed size: tokens that share a bucket look more frequent than they are.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LEAST_TOKEN, STOPWORDS, normalise_name
from ..plans.tables import discarded, settled

#: Buckets that uses are counted in, and how many of them a row of the collected table holds.
COUNTERS, SLICE = 1 << 24, 1 << 16
#: Bits of the filter that names the rows whose sets are wanted.
FILTER = 1 << 24
#: Tokens of the prefixes that two sets have to share, where they have to share as many at all.
TOGETHER = 4
#: Level (see ``_levels``) above which a token is frequent: 64 uses. Groups of frequent tokens for each token of a set.
FREQUENT, GROUPS = 48, 0.2
#: Rounds that the meetings are found in, by size, and the tokens of all sets below which one is enough.
ROUNDS, FEW = 6, 2_000_000
#: Bits of a meeting's place; above them are a bit for pairs of tokens and, as the sign, that the set is of the next class.
PLACE = 29
#: A row's number holds its set's size above so many bits, its partition above ``ROW`` and its place in that below.
SIZE, ROW = 43, 27
#: Rows of a family that are compared with as many others in one cell.
BLOCK = 512
#: Rows of a batch whose texts a task holds as Python strings at once.
AT_ONCE = 500
#: Token hashes that a task remembers.
REMEMBERED = 100_000
_STOP = frozenset(STOPWORDS)


def tokens_of(name: str | None) -> set[str]:
    """``functions.text.salient_tokens`` of a normalised name, as a set."""
    out = {t for t in (name or "").split(" ") if len(t) >= LEAST_TOKEN} - _STOP
    return {t[:-1] if len(t) > LEAST_TOKEN and t[-1] == "s" else t for t in out}


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Hashes:
    """Sorted hashes of token sets, different for each type."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, kind: str | None, tokens: set[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for t in tokens.difference(self.known):
            self.known[t] = _number(t)
        out = np.fromiter((self.known[t] for t in tokens), np.uint64, len(tokens)) ^ np.uint64(_number(f"type {kind}"))
        out.sort()
        return out


def _known(entities: DataFrame, name: Column) -> DataFrame:
    return entities.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("type").cast("string").alias("type"), name.alias("name"))


def _normal(entities: DataFrame, name: Column) -> DataFrame:
    return _known(entities, name).withColumn("name", normalise_name(F.col("name")))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _split(batch: pa.RecordBatch, hashes: _Hashes) -> Iterator[tuple[str, str | None, set[str], np.ndarray]]:
    for i, kind, name in zip(*(batch.column(c).to_pylist() for c in ("id", "type", "name")), strict=True):
        if tokens := tokens_of(name):
            yield i, kind, tokens, hashes.of(kind, tokens)


def digests(entities: DataFrame, name: Column) -> DataFrame:
    """id, type, key (a digest of the token set; tokens hold no spaces) of rows with salient tokens."""

    def run(batches):
        for batch in _slices(batches):
            rows = [(i, kind, hashlib.sha256(" ".join(sorted(tokens)).encode("utf-8", "surrogatepass")).digest()) for i, kind, name in zip(*(batch.column(c).to_pylist() for c in ("id", "type", "name")), strict=True) if (tokens := tokens_of(name))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["id", "type", "key"])

    return _normal(entities, name).mapInArrow(run, "id string, type string, key binary")


def _levels(normal: DataFrame) -> np.ndarray:
    """For each counter a byte: 0 for at most one use, else eight steps for each doubling of the uses."""

    def count(batches):
        hashes = _Hashes()
        for batch in _slices(batches):
            found = [h for *_, h in _split(batch, hashes)]
            slots, n = np.unique(np.concatenate(found) % np.uint64(COUNTERS), return_counts=True) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n.astype(np.int64))], names=["slot", "n"])

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SLICE, np.uint8)
        out[rows["slot"].to_numpy() % SLICE] = np.minimum(255, 8 * np.log2(rows["n"].to_numpy())).astype(np.uint8)
        return pd.DataFrame({"part": [rows["slot"].iloc[0] // SLICE], "levels": [out.tobytes()]})

    used = normal.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    out = np.zeros(COUNTERS, np.uint8)
    for r in used.groupBy(F.floor(F.col("slot") / SLICE).alias("_p")).applyInPandas(packed, "part int, levels binary").toLocalIterator():
        out[r["part"] * SLICE : (r["part"] + 1) * SLICE] = np.frombuffer(r["levels"], np.uint8)
    return out


def signature(hashes: np.ndarray) -> bytes:
    """As many bits as the next power of two over the set's size, each the parity of the tokens that fall on it."""
    width = 1 << max(6, int(len(hashes)).bit_length())
    odd = np.bincount((hashes >> np.uint64(24)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """The least number of tokens that two sets with these signatures differ in."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    wide, narrow = max(len(a), len(b)) * 8, min(len(a), len(b)) * 8
    if len(a) < len(b):
        x, y = y, x
    while wide > narrow:
        wide //= 2
        x = (x >> wide) ^ (x & ((1 << wide) - 1))
    return (x ^ y).bit_count()


def size_classes(least: float, largest: int) -> list[int]:
    """Where the classes of sizes start: a set is near sets of its own class and the next ones on both sides alone."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(math.floor(starts[-1] / least + 1e-6) + 1)
    return starts


def _groups(start: int, least: float) -> int:
    """Groups that frequent tokens are dealt in where the smaller set is of the class that starts so; 0 where sets are too small."""
    return max(0, min(max(1, int(GROUPS * start)), math.ceil(least * start - 1e-9) - 2 * TOGETHER + 1))


def _together(start: int, least: float) -> int:
    """Shared tokens that prefixes have to reach for such pairs: up to TOGETHER - 1 rare ones, and TOGETHER more frequent ones than groups."""
    groups = _groups(start, least)
    return groups + 2 * TOGETHER - 1 if groups else TOGETHER


def _heads(normal: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """id, type, n, sign, prefix (tokens), places (of these in the order of uses), rare (how many of them are) of all rows."""
    held = normal.sparkSession.sparkContext.broadcast(levels.tobytes())

    def run(batches):
        hashes, level = _Hashes(), np.frombuffer(held.value, np.uint8)
        starts = size_classes(least, 1 << 20)
        for batch in _slices(batches):
            rows = []
            for i, kind, _, h in _split(batch, hashes):
                often = level[h % np.uint64(COUNTERS)]
                while starts[-1] <= len(h):
                    starts = size_classes(least, 2 * len(h))
                # similarity >= s needs an overlap of at least s * n, so k of the first n - ceil(s * n) + k tokens are shared
                first = np.lexsort((h, often))[: len(h) - math.ceil(least * len(h) - 1e-9) + _together(starts[bisect_right(starts, len(h)) - 1], least)]
                place = np.flatnonzero(often[first] > 0)
                rows.append((i, kind, len(h), signature(h), h[first[place]].view(np.int64), place.astype(np.int32), int(np.count_nonzero(often[first[place]] <= FREQUENT))))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "type", "n", "sign", "prefix", "places", "rare"])

    return normal.mapInArrow(run, "id string, type string, n int, sign binary, prefix array<long>, places array<int>, rare int")


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def meeting_keys(tokens: np.ndarray, places: np.ndarray, rare: int, n: int, start: int, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(keys, places, how many of these are tokens; pairs of tokens follow) of a set where the smaller one is of the class that starts so."""
    groups, base = _groups(start, least), n - math.ceil(least * n - 1e-9)
    alone = int(np.searchsorted(places, base + TOGETHER))
    alone = min(alone, rare) if groups else alone
    single = _mixed(tokens[:alone], 2 * start)
    if not groups:
        return single, places[:alone], alone
    end = int(np.searchsorted(places, base + _together(start, least)))
    often, at = tokens[rare:end], places[rare:end]
    group = (often >> np.uint64(20)) % np.uint64(groups)
    order = np.argsort(group, kind="stable")  # within a group in the order of uses
    often, at, group = _mixed(often[order], 2 * start + 1), at[order], group[order]
    keys, found = [single], [places[:alone]]
    for step in range(1, len(often)):
        same = group[step:] == group[:-step]
        if not same.any():
            break
        keys.append(_mixed(often[step:][same], 1) + often[:-step][same])
        found.append(at[step:][same])
    return np.concatenate(keys), np.concatenate(found), alone


def _meetings(heads: DataFrame, least: float, first: int, last: int) -> DataFrame:
    """key, doc, i (place of the key's last token, see ``PLACE``): where sets meet if the smaller one has first to last - 1 tokens (bounds of classes)."""

    def run(batches):
        for batch in _slices(batches):
            out: list[list] = [[], [], []]
            lists = [batch.column(c) for c in ("prefix", "places")]
            for doc, n, rare, tokens, places in zip(*(batch.column(c).to_pylist() for c in ("doc", "n", "rare")), *([x.values.to_numpy(zero_copy_only=False)[a:b] for a, b in zip(x.offsets.to_pylist()[:-1], x.offsets.to_pylist()[1:], strict=True)] for x in lists), strict=True):
                starts = size_classes(least, n)
                c = bisect_right(starts, n) - 1
                for at in (c, c - 1):
                    if at < 0 or not first <= starts[at] < last or (at < c and math.ceil(least * n - 1e-9) >= starts[c]):
                        continue
                    keys, found, alone = meeting_keys(tokens.view(np.uint64), places, rare, n, starts[at], least)
                    found = found | (np.arange(len(keys)) >= alone).astype(np.int32) << PLACE
                    for k, x in enumerate((keys.view(np.int64), np.full(len(keys), doc), found if at == c else found - (1 << PLACE + 1))):
                        out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["key", "doc", "i"])

    near = (F.col("n") >= first) & (F.lit(least) * F.col("n") - 1e-9 < last)
    return heads.where(near).select("doc", "n", "rare", "prefix", "places").mapInArrow(run, "key long, doc long, i int")


def _rounds(heads: DataFrame, least: float) -> list[tuple[int, int]]:
    """Ranges of sizes (from, to before) with about as many tokens each, cut where classes are."""
    largest = heads.agg(F.max("n")).first()[0] or 1
    starts = size_classes(least, largest)
    at = F.lit(0)
    for start in starts:
        at = F.when(F.col("n") >= start, F.lit(start)).otherwise(at)
    held = {r[0]: r[1] for r in heads.groupBy(at.alias("start")).agg(F.sum("n")).collect()}
    share, out, inside = max(FEW, sum(held.values()) / ROUNDS), [1], 0
    for start in starts[:-1]:
        if inside and inside + held.get(start, 0) > share:
            out.append(start)
            inside = 0
        inside += held.get(start, 0)
    return list(zip(out, [*out[1:], starts[-1]], strict=True))


def _sets(entities: DataFrame, name: Column, wanted: DataFrame) -> DataFrame:
    """doc, hashes of the wanted rows (doc, id, type); a filter of fixed size leaves few others to be split and joined."""
    slot = F.pmod(F.xxhash64("id", "type"), F.lit(FILTER)).cast("int")
    bits = np.zeros(FILTER // 8, np.uint8)
    parts = wanted.select(slot.alias("slot")).distinct().groupBy(F.floor(F.col("slot") / SLICE).alias("_p"))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(SLICE, np.uint8)
        out[rows["slot"].to_numpy() % SLICE] = 1
        return pd.DataFrame({"part": [rows["slot"].iloc[0] // SLICE], "bits": [np.packbits(out, bitorder="little").tobytes()]})

    for r in parts.applyInPandas(packed, "part int, bits binary").toLocalIterator():
        bits[r["part"] * SLICE // 8 : (r["part"] + 1) * SLICE // 8] = np.frombuffer(r["bits"], np.uint8)
    held = entities.sparkSession.sparkContext.broadcast(bits.tobytes())

    def chosen(batches):
        named = np.frombuffer(held.value, np.uint8)
        for batch in _slices(batches):
            slots = batch.column("slot").to_numpy()
            yield batch.select(["id", "type", "name"]).filter(pa.array((named[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1))

    def run(batches):
        hashes = _Hashes()
        for batch in _slices(batches):
            rows = [(i, kind, h.tobytes()) for i, kind, _, h in _split(batch, hashes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))], names=["id", "type", "hashes"])

    texts = _known(entities, name).withColumn("slot", slot).mapInArrow(chosen, "id string, type string, name string")
    read = _normal(texts, F.col("name")).mapInArrow(run, "id string, type string, hashes binary")
    return read.join(wanted, (read["id"] == wanted["id"]) & read["type"].eqNullSafe(wanted["type"])).select("doc", "hashes")


def _may_be_near(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([differing(x, y) <= m for x, y, m in zip(a, b, most, strict=True)], dtype=bool)


def _overlaps(key: tuple, pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a cell with the size of their sets' intersection."""
    of = {d: np.frombuffer(h, np.uint64) for d, h in zip(sets["doc"], sets["hashes"], strict=True)}
    shared = [len(np.intersect1d(of[x], of[y], assume_unique=True)) for x, y in zip(pairs["a"], pairs["b"], strict=True)]
    return pairs[["a", "b", "n", "m"]].assign(k=np.array(shared, np.int32))


def _overlapping(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, n, m, k (tokens in common) of pairs.

    Near copies come in families, where pairs are many times the sets. A pair goes to the cell of its first row's family
    (named by the least row near it), small families share a cell, large ones have one for each two of their blocks: a
    set moves once for each cell that needs it, not once for each pair.
    """
    ends = pairs.select(F.col("a").alias("doc"), F.least("a", "b").alias("_l")).unionByName(pairs.select(F.col("b").alias("doc"), F.least("a", "b").alias("_l")))
    family = ends.groupBy("doc").agg(F.min("_l").alias("family"))
    sized = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    many = max(1, sets.count() // BLOCK)
    blocks = lambda d: F.pmod(F.xxhash64(d), F.col("blocks")).cast("int")
    placed = pairs.join(family.withColumnRenamed("doc", "a"), "a").join(sized, "family")
    cell = ["cell", "x", "y"]
    placed = settled(placed.select(F.pmod(F.xxhash64("family"), F.lit(many)).cast("int").alias("cell"), blocks("a").alias("x"), blocks("b").alias("y"), "a", "b", "n", "m"), "cells")
    needed = placed.select(*cell, F.col("a").alias("doc")).unionByName(placed.select(*cell, F.col("b").alias("doc"))).distinct()
    held = needed.join(sets, "doc").select("cell", "x", "y", "doc", "hashes").toDF("cell2", "x2", "y2", "doc", "hashes")
    return placed.groupBy(*cell).cogroup(held.groupBy("cell2", "x2", "y2")).applyInPandas(_overlaps, "a long, b long, n int, m int, k int")


def _standing(heads: DataFrame, keys: DataFrame, least: float) -> DataFrame:
    """a, b, n, m (sizes) of rows that meet often enough, unless their signatures differ too much."""
    other = keys.select("key", F.col("doc").alias("b"), F.col("i").alias("_j"))
    n, m = F.shiftright("a", SIZE), F.shiftright("b", SIZE)
    needed = F.ceil(F.lit(least / (1 + least)) * (n + m) - 1e-9)
    # what stands before a shared token, the token, and what stands behind it have to make up the overlap
    i, j = F.col("i").bitwiseAND((1 << PLACE) - 1), F.col("_j").bitwiseAND((1 << PLACE) - 1)
    # a set of the next class is never the smaller one: its place is below zero, which reaches nothing
    reach = F.least(F.when(F.col("i") < 0, F.col("i")).otherwise(i), j) + 1 + F.least(n - 1 - i, m - 1 - j) >= needed
    near_size = F.least(n, m) >= F.lit(least) * F.greatest(n, m) - 1e-9
    met = keys.withColumnRenamed("doc", "a").join(other, "key").where((F.col("a") < F.col("b")) & near_size & reach)
    # meetings at rare tokens and at two frequent ones are counted apart
    met = met.select(F.when(F.col("i").bitwiseAND(1 << PLACE) != 0, F.bitwise_not("a")).otherwise(F.col("a")).alias("_a"), "b").groupBy("_a", "b").agg(F.count(F.lit(1)).alias("k"))
    met = met.select(F.when(F.col("_a") < 0, F.bitwise_not("_a")).otherwise(F.col("_a")).alias("a"), "b", "k").where(F.col("k") >= F.least(F.lit(TOGETHER), needed)).select("a", "b").distinct()
    signs = heads.select("doc", "n", "sign")
    signed = met.join(signs.select(F.col("doc").alias("a"), "n", F.col("sign").alias("_s")), "a").join(signs.select(F.col("doc").alias("b"), F.col("n").alias("m"), F.col("sign").alias("_t")), "b")
    most = F.lit((1 - least) / (1 + least)) * (F.col("n") + F.col("m")) + 1e-9
    return signed.where(F.pandas_udf(_may_be_near, "boolean")("_s", "_t", most)).select("a", "b", "n", "m")


def similar(entities: DataFrame, name: Column, classes: DataFrame, least: float) -> DataFrame:
    """type, a, b, similarity of pairs of classes (type, rep) whose token sets are similar enough, each pair once."""
    normal = _normal(entities, name)
    heads = _heads(normal, _levels(normal), least)
    reps = classes.select(F.col("rep").alias("_id"), F.col("type").alias("_type"))
    heads = heads.join(reps, (F.col("id") == F.col("_id")) & F.col("type").eqNullSafe(F.col("_type")), "left_semi")
    at = F.monotonically_increasing_id()
    heads = settled(heads.withColumn("doc", F.shiftleft(F.col("n").cast("long"), SIZE).bitwiseOR(F.shiftleft(F.shiftright(at, 33), ROW)).bitwiseOR(at.bitwiseAND((1 << 33) - 1))), "heads")
    pairs = None
    for first, last in _rounds(heads, least):  # each round's meetings are gone from disk before the next one's come
        found = settled(_standing(heads, _meetings(heads, least, first, last), least), "pairs")
        pairs = found if pairs is None else pairs.unionByName(found)
    docs = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    wanted = settled(heads.select("doc", "id", "type").join(docs, "doc", "left_semi"), "wanted")
    discarded(heads)
    sets = settled(_sets(entities, name, wanted), "sets")
    scored = _overlapping(pairs, sets).select("a", "b", (F.col("k") / (F.col("n") + F.col("m") - F.col("k"))).alias("similarity")).where(F.col("similarity") >= least)
    named = wanted.select(F.col("doc"), "id", "type")
    x, y = named.select(F.col("doc").alias("a"), F.col("id").alias("_x"), "type"), named.select(F.col("doc").alias("b"), F.col("id").alias("_y"))
    return scored.join(x, "a").join(y, "b").select("type", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")
