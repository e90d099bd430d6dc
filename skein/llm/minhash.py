"""Near-duplicate groups by fast similarity sketching, banding and exact verification.

A document's set holds hashes of its distinct word shingles. Its sketch has ``COORDS`` coordinates:
in round i every element is thrown into a hashed bin with a hashed value, an empty bin keeps the
smallest value that reaches it, and rounds go on until no bin is empty; the last ``COORDS`` rounds
name their bin outright, so every coordinate is filled whatever the set's size, and the share of
equal coordinates concentrates around the Jaccard similarity as for a full MinHash. Large sets need
one or two rounds instead of ``COORDS``.

Documents with equal sets are one class, represented by its smallest doc_id. Representatives that
agree on a band of ``ROWS`` coordinates share a bucket. In a bucket, all are compared with one
pivot, drawn in another order for each bucket, so a bucket costs as many pairs as it has members.
Links are confirmed on the full sets. Buckets whose members these links leave in several components
are joined to families, and a family's members are compared in blocks: by sketch, and on the full
sets where that allows a link. Pairs that are connected already are skipped and only links that
connect more leave a block, so no pair that shares a bucket is lost to the choice of a pivot, and no
group of copies turns into all its pairs. Components come from rounds of smallest
labels with pointer jumping, each round written to the shared folder.

A pair at similarity 0.8 misses all 32 bands of 4 with a probability of about 5e-8.

Cases: null and wordless texts have an empty set and are linked with nothing; with fewer words than
a shingle has, the whole sequence is the one shingle; equal texts are one class. Rows that repeat a
doc_id are one document: what any of their texts is linked with is one component, and all of them are
kept or dropped together (a row of it without words stays alone). Rows without doc_id are linked like
others; theirs is the smallest doc_id of the component, null if no row in it has one, and they are kept
only then. An empty table gives an empty result; other columns are ignored here and carried by
``kept_documents``. A text is hashed whole: arrays of about 40 bytes per byte of the longest one are held
while it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, give_back, joined, table, text_slices, written

COORDS, ROWS = 128, 4
BANDS = COORDS // ROWS
BIN_BITS = 7
#: A pair of this similarity agrees on 102 of 128 coordinates on average, with a deviation below 5.
LEAST_EQUAL = 70
#: Members of a family that are compared with as many others in one task, and cells of its table of shared elements.
BLOCK, DENSE = 256, 64 << 20
#: Ids up to this many (8 bytes each) are broadcast to pick texts; more are joined by shuffle.
SMALL_IDS = 500_000

_M = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240607))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
WORD = np.ones(256, bool)
WORD[[9, 10, 11, 12, 13, 32]] = False
BASE = _M(0x9E3779B97F4A7C15)
BASE_INVERSE = _M(pow(0x9E3779B97F4A7C15, -1, 2**64))
ORDER = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _M(1)
ROUND = _rng.integers(1, 2**63, 2 * COORDS, dtype=np.uint64)
EMPTY = _M(2**64 - 1)
_SPAN = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the word hash's base and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = _powers(BASE, n), _powers(BASE_INVERSE, n)
        return self.up, self.down


def word_hashes(offsets: np.ndarray, data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) of some texts' bytes."""
    inside = WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if len(data) else starts
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of bounded length, cut between words
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, low + _SPAN, "right")))
        up, down = powers.upto(int(ends[to - 1] - low) + 1)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[data[low : ends[to - 1]]] * up[: ends[to - 1] - low], dtype=np.uint64)))
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mixed((run[b] - run[a]) * down[a] + (b - a).astype(np.uint64))
        at = to
    return out, np.searchsorted(starts, offsets)


def shingle_sets(offsets: np.ndarray, data: np.ndarray, words: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one after the other; bounds of each text's)."""
    hashes, bounds = word_hashes(offsets, data, powers)
    n = np.diff(bounds)
    if len(hashes) >= words:
        m = len(hashes) - words + 1
        total = np.zeros(m, np.uint64)
        for j in range(words):
            total += hashes[j : j + m] * ORDER[j]
        total = mixed(total)
    else:
        total = np.zeros(0, np.uint64)
    sets, sizes = [], np.zeros(len(n), np.int64)
    for k in range(len(n)):
        if n[k] >= words:
            s = np.sort(total[bounds[k] : bounds[k + 1] - words + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif n[k]:
            h = hashes[bounds[k] : bounds[k + 1]]
            s = mixed(np.array([(h * ORDER[: len(h)]).sum(dtype=np.uint64) ^ ORDER[words + len(h)]], np.uint64))
        else:
            continue
        sets.append(s)
        sizes[k] = len(s)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def sketches(elements: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of ``COORDS`` values for each set; a row of ``EMPTY`` for an empty set."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out = np.full(n * COORDS, EMPTY, np.uint64)
    for i in range(2 * COORDS):
        if not len(elements):
            break
        value = mixed(elements ^ ROUND[i])
        bins = owner * COORDS + ((value >> _M(64 - BIN_BITS)).astype(np.int64) if i < COORDS else i - COORDS)
        value &= _M((1 << (64 - BIN_BITS)) - 1)
        if i:
            free = out[bins] == EMPTY
            bins, value = bins[free], value[free]
        np.minimum.at(out, bins, value)
        left = (out.reshape(n, COORDS) == EMPTY).any(1)[owner]
        if not left.all():
            elements, owner = elements[left], owner[left]
    return out.reshape(n, COORDS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key for each band, different between bands."""
    grouped = sketch.reshape(len(sketch), BANDS, ROWS)
    total = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sketch), 1))
    for j in range(ROWS):
        total = total + grouped[:, :, j] * ORDER[j]
    return mixed(total * _M(0xD6E8FEB86659FD93))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _digests(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    some = np.diff(bounds) > 0
    d1, d2 = np.zeros(len(some), np.uint64), np.zeros(len(some), np.uint64)
    if some.any():
        d1[some] = np.add.reduceat(mixed(elements ^ ORDER[40]), bounds[:-1][some])
        d2[some] = np.bitwise_xor.reduceat(mixed(elements ^ ORDER[41]), bounds[:-1][some])
    return d1.view(np.int64), d2.view(np.int64)


def signatures(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th (hash of the text), n (set size), d1 and d2 (digest of the set), bands, sketch (16 bits of each coordinate)."""
    chosen = docs.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    schema = "doc bigint, th bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for a, b, offsets, data in text_slices(batch, "text", 1 << 20):
                elements, bounds = shingle_sets(offsets, data, words, powers)
                n, some = np.diff(bounds), np.diff(bounds) > 0
                d1, d2 = _digests(elements, bounds)
                sketch = sketches(elements, bounds)
                small = np.ascontiguousarray((sketch & _M(0xFFFF)).astype(np.uint16))
                per = np.where(some, BANDS, 0)
                keys = band_keys(sketch)[some].reshape(-1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), _lists(keys, np.concatenate(([0], np.cumsum(per)))), pa.array([row.tobytes() for row in small], pa.binary())],
                    ["doc", "th", "n", "d1", "d2", "bands", "sketch"],
                )
        give_back()

    return chosen.mapInArrow(sign, schema)


def full_sets(docs: DataFrame, classes: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """rep, elements: the sets of some classes (rep, of: a doc_id that has the set, n, d1, d2)."""
    ids = classes.select(F.col("of").alias("_of")).distinct()
    few = classes.count() <= SMALL_IDS
    chosen = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    chosen = chosen.join(F.broadcast(ids) if few else ids, F.col("doc").eqNullSafe(F.col("_of")), "left_semi").select("text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for _, _, offsets, data in text_slices(batch, "text", 1 << 20):
                elements, bounds = shingle_sets(offsets, data, words, powers)
                d1, d2 = _digests(elements, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(bounds), pa.int64()), pa.array(d1), pa.array(d2), _lists(elements, bounds)], ["n", "d1", "d2", "elements"])
        give_back()

    sets = chosen.mapInArrow(build, "n bigint, d1 bigint, d2 bigint, elements array<bigint>")
    # the doc_ids bring a few texts of other classes where doc_ids repeat
    return sets.join(classes.select("rep", "n", "d1", "d2"), ["n", "d1", "d2"]).select("rep", "elements").dropDuplicates(["rep"])


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of classes whose full sets have 100 * intersection >= percent * union; the sets of all in pairs), written."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = written(full_sets(docs, written(classes.join(ids, "rep"), "ids"), words, key, text), "sets")
    with_a = pairs.join(sets.select(F.col("rep").alias("a"), F.col("elements").alias("ea")), "a")
    both = with_a.join(sets.select(F.col("rep").alias("b"), F.col("elements").alias("eb")), "b")
    common = F.size(F.array_intersect("ea", "eb"))
    kept = both.select("a", "b", common.alias("i"), (F.size("ea") + F.size("eb")).alias("s")).where(f"100 * i >= {percent} * (s - i)")
    return written(kept.select("a", "b"), "links"), sets


def _same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes that the rows of one doc_id are in."""
    name = F.struct("n", "d1", "d2")
    several = signed.where("n > 0 and doc is not null").groupBy("doc").agg(F.min(name).alias("lo"), F.max(name).alias("hi")).where("lo <> hi").select("doc")
    if several.isEmpty():
        return several.select(F.col("doc").alias("a"), F.col("doc").alias("b"))
    of = signed.join(several, "doc").select("doc", "n", "d1", "d2").distinct().join(classes.select("rep", "n", "d1", "d2"), ["n", "d1", "d2"])
    first = of.groupBy("doc").agg(F.min("rep").alias("a"))
    return written(of.join(first, "doc").where("a <> rep").select("a", F.col("rep").alias("b")), "same-document")


def components(links: DataFrame) -> DataFrame:
    """doc, comp: the smallest doc of its component, for every doc in a link (columns a, b).

    In each round every doc hooks on to its smallest neighbour, hooks are followed once more, and the
    links are drawn between the labels instead; links within a label fall away, so rounds shrink fast.
    """
    edges = written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    state, past = edges.select(F.col("a").alias("doc"), F.col("a").alias("comp")).distinct(), []
    done: list[DataFrame] = []
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("near")).select("doc", F.least("doc", "near").alias("to"))
        ends = written(hooks.join(hooks.select(F.col("doc").alias("to"), F.col("to").alias("end")), "to").select("doc", "end"), "ends")
        # labels are looked up at the end, through the ends of every round: a few joins, as rounds are few
        state = state.join(ends.withColumnRenamed("doc", "comp"), "comp", "left").select("doc", F.coalesce("end", "comp").alias("comp"))
        from_a = edges.join(ends.select(F.col("doc").alias("a"), F.col("end").alias("la")), "a")
        drawn = from_a.join(ends.select(F.col("doc").alias("b"), F.col("end").alias("lb")), "b").where("la <> lb")
        past.append(edges)
        edges = written(drawn.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "edges")
        done.append(ends)
    labels = written(state, "labels")
    discarded(*past, *done)
    return labels


def _intersections(sets: list[np.ndarray]) -> Callable[[int, np.ndarray], np.ndarray]:
    """A function (one set, others) -> sizes of their intersections, for sorted distinct elements."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    tokens, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1  # an element of one set only is in no intersection
    columns = (np.cumsum(counts > 1) - 1)[inverse[shared]]
    width = int((counts > 1).sum())
    if len(sets) * width <= DENSE:
        dense = np.zeros((len(sets), max(1, width)), np.uint8)
        dense[owner[shared], columns] = 1
        return lambda x, others: dense[np.ix_(others, np.flatnonzero(dense[x]))].sum(1, dtype=np.int64)
    return lambda x, others: np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for y in others], np.int64)


def _block_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a family, confirmed on full sets.

    members: family, doc, n, comp, sketch, elements. Families are split into blocks; each task looks
    at two blocks, skips pairs that are connected already, and returns the links that connect more.
    """
    counts = members.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(counts, "family").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc", "n", "comp", "sketch", "elements")

    def compare(pdf):
        import pandas as pd  # only in tasks that need it: workers of other stages stay smaller

        sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), COORDS)
        doc, n, block = (pdf[c].to_numpy() for c in ("doc", "n", "block"))
        comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1].reshape(-1)
        common = _intersections(list(pdf["elements"]))
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = [], []
        for x in left:
            fits = (comp[right] != comp[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))
            if i == j:
                fits &= doc[right] > doc[x]
            near = right[fits]
            near = near[(sketch[near] == sketch[x]).sum(1) >= LEAST_EQUAL]
            if not len(near):
                continue
            inter = common(x, near)
            for y in near[100 * inter >= percent * (n[near] + n[x] - inter)]:
                if comp[y] != comp[x]:
                    comp[comp == comp[y]] = comp[x]
                    a.append(min(doc[x], doc[y]))
                    b.append(max(doc[x], doc[y]))
        del sketch, common
        give_back()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return dealt.groupBy("family", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def grouped(docs: DataFrame, words: int, percent: int, key: str, text: str) -> DataFrame:
    """doc, th (hash of the text), n, component (smallest doc_id), kept of every row."""
    numbered = signatures(docs, words, key, text).withColumn("row", F.monotonically_increasing_id())
    signed = written(numbered, "signatures")
    # a class of equal sets is named by its first row
    classes = signed.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("row").alias("rep"), F.min("doc").alias("of"), F.count(F.lit(1)).alias("rows"))
    classes = written(classes, "classes")
    reps = signed.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").withColumnRenamed("row", "rep")

    rows = reps.select("rep", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min_by("rep", F.xxhash64("rep", "key")).alias("pivot")).where("members > 1")
    buckets = written(buckets, "buckets")
    shared = written(joined(rows, buckets, ["key"], buckets, "members"), "shared")
    star = shared.where("rep <> pivot").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    links, sets = confirmed(star, docs, classes, words, percent, key, text)
    links = links.union(_same_document(signed, classes))
    comps = components(links).withColumnRenamed("doc", "rep")

    # Buckets of three or more whose members ended up in several components: every such pair is looked at.
    labelled = shared.where("members > 2").select("key", "rep").join(comps, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key", "lo")
    rest = written(labelled.join(split, "key").select("rep", "lo", "comp").distinct(), "rest")
    if not rest.isEmpty():
        families = components(rest.select(F.col("lo").alias("a"), F.col("comp").alias("b")).distinct()).select(F.col("doc").alias("comp"), F.col("comp").alias("family"))
        members = rest.select("rep", "comp").distinct().join(families, "comp").join(reps.select("rep", "n", "sketch"), "rep").join(sets, "rep").withColumnRenamed("rep", "doc")
        found = written(_block_links(members, percent), "block-links")
        if not found.isEmpty():
            comps = components(links.union(found)).withColumnRenamed("doc", "rep")

    # Each class of equal sets hangs on its component, and the component on its smallest doc_id.
    placed = comps.join(classes, "rep")
    least = placed.groupBy("comp").agg(F.min("of").alias("component"))
    linked = placed.join(least, "comp").select("d1", "d2", "n", "rows", "component")
    copies = classes.where("rows > 1").join(comps.select("rep"), "rep", "left_anti").select("d1", "d2", "n", "rows", F.col("of").alias("component"))
    known = linked.unionByName(copies).drop("rows").withColumn("_known", F.lit(True))
    out = joined(signed.select("doc", "th", "n", "d1", "d2"), known, ["d1", "d2", "n"], classes, "rows", "left")
    component = F.when(F.col("_known"), F.col("component")).otherwise(F.col("doc"))
    return out.select("doc", "th", "n", component.alias("component"), F.col("doc").eqNullSafe(component).alias("kept"))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept."""
    return grouped(docs, words, percent, key, text).select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def kept_documents(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id."""
    dropped = grouped(docs, words, percent, key, text).where("not kept").select(F.col("doc").alias("_key"), F.col("th").alias("_th")).distinct()
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(F.col(text)).alias("_of"), F.struct(*docs.columns).alias("_row"))
    stay = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_of") == F.col("_th")), "left_anti")
    return stay.select("_row.*")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    return near_groups(table(spark, sf_dir, "documents"), words=4)
