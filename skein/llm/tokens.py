"""Token ids of documents as compact binary files, in ascending doc_id order.

Rows are range-partitioned and sorted by doc_id; each task tokenizes its texts and writes files of up
to about ``FILE_IDS`` ids (more only where one document has more). A file holds a table of its
documents (doc_id, number of ids) and its ids in blocks of ``BLOCK_IDS``, each coded by itself with
an adaptive context-mixing range coder (``rangecoder``) and checked by checksums when read. Files are
written by Spark's own writer, one row each, so tasks may be repeated; the line end that the writer
adds is cut off by the reader.

A text's ids are those of its pieces one after the other: the bytes of many texts are cut at once where
the tokenizer's own pattern cuts; texts with other characters than ASCII, Latin letters and common signs
are cut one by one, and only at white space around such characters. A worker remembers the ids of pieces,
up to about ``WORDS`` of them.

Cases: null text counts as empty and has only the end id; rows without doc_id come first; rows that
repeat a doc_id follow each other, ordered by text; an empty table writes no file and reads back as an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import give_back, new_path, table, text_slices, written
from .merges import PAD, Merges

END = 2
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 22
#: Pieces that a worker remembers, slots of their table, and bytes of a piece that the table holds.
WORDS, SLOT_BITS, SHORT = 800_000, 21, 15
SLOTS = 1 << SLOT_BITS
MAGIC = b"IDS1"
_HEAD = struct.Struct("<4sqqIIII")
#: The tokenizer's own pieces of lower-cased text: letters with a contraction, a contraction, digits (which it takes
#: one by one), and all other signs up to the next white space, letter or digit.
_LETTERS, _SIGNS, _ENDING = "a-zÀ-ÖØ-öø-įı-ſ", "«»‐-‧", "'(?:[stmd]|re|ve|ll)"
_PIECES = re.compile(rf"[{_LETTERS}]+(?:{_ENDING})?|{_ENDING}|[0-9]+|[^ \t-\r0-9{_LETTERS}]+")
#: Stretches between ASCII white space, and a character whose class or normal form is left to the tokenizer.
_STRETCHES, _OTHER = re.compile(r"[^ \t-\r]+"), re.compile(rf"[^\x00-\x7f{_LETTERS}{_SIGNS}]")

_U = np.uint64
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SPACE, _LETTER, _DIGIT, _SIGN = range(4)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0xC3:0xC6] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, bool)
_ENDS[list(b"stmd")] = True


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """Parts of a text whose ids, one after the other, are the text's: pieces, or stretches that hold other characters."""
    raw = text.encode("utf-8", "replace")
    # signs of special tokens, and marks that may join a letter before it is lower-cased (all of U+0300 to U+036F)
    if "<|" in text or b"\xcc" in raw or b"\xcd" in raw:
        return _STRETCHES.findall(text)
    low = raw.lower().decode()  # ASCII only, so that words are shared
    if low.isascii() or not _OTHER.search(low):
        return _PIECES.findall(low)
    return [p for s in _STRETCHES.findall(low) for p in ([s] if _OTHER.search(s) else _PIECES.findall(s))]


class WordIds:
    """The tokenizer's pieces of texts, cut side by side, with a memory of pieces.

    A piece of up to ``SHORT`` bytes is named by its bytes and length in two 64-bit numbers, so that equal names are
    equal pieces, and is found in a table by hash. New pieces are merged side by side. Longer pieces, and texts with
    characters that the tables of classes leave out, go to the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size()
        vocabulary, alphabet = self.model.get_vocab(), byte_alphabet()
        self.inner = np.array([vocabulary[c] for c in alphabet], np.uint16)
        self.last = np.array([vocabulary[c + "</w>"] for c in alphabet], np.uint16)
        with open(path, encoding="utf-8") as f:
            pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in json.load(f)["model"]["merges"]]
        left, right, made = (np.array([vocabulary[x] for x in side]) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        self.merges = Merges(left, right, np.arange(len(pairs)), made)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, np.ndarray] = {}
        self.long: dict[bytes, int] = {}
        self.low, self.high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.entry = np.zeros(SLOTS, np.int32)
        self.start, self.count = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.pool, self.entries, self.pooled = np.zeros(1 << 18, np.uint16), 0, 0

    # --- memory of pieces ---------------------------------------------------------------------

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Entries for pieces with these ids, one after the other."""
        n, size = len(counts), len(ids)
        while self.entries + n > len(self.start):
            self.start, self.count = (np.concatenate((x, np.zeros_like(x))) for x in (self.start, self.count))
        while self.pooled + size > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.start[self.entries : self.entries + n] = self.pooled + np.cumsum(counts) - counts
        self.count[self.entries : self.entries + n] = counts
        self.pool[self.pooled : self.pooled + size] = ids
        self.entries, self.pooled = self.entries + n, self.pooled + size
        return np.arange(self.entries - n, self.entries, dtype=np.int32)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each name, -1 for those that are not known."""
        slot = _slots(low, high)
        hit = (self.low[slot] == low) & (self.high[slot] == high)
        out = np.where(hit, self.entry[slot], np.int32(-1))
        rest = np.flatnonzero(~hit & (self.high[slot] != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (SLOTS - 1)
            at = slot[rest]
            hit = (self.low[at] == low[rest]) & (self.high[at] == high[rest])
            out[rest[hit]] = self.entry[at[hit]]
            rest = rest[~hit & (self.high[at] != 0)]
        return out

    def _store(self, low: np.ndarray, high: np.ndarray, entry: np.ndarray) -> None:
        slot = _slots(low, high)
        while len(slot):
            free = np.flatnonzero(self.high[slot] == 0)
            took = free[np.unique(slot[free], return_index=True)[1]]
            self.low[slot[took]], self.high[slot[took]], self.entry[slot[took]] = low[took], high[took], entry[took]
            left = np.ones(len(slot), bool)
            left[took] = False
            low, high, entry, slot = low[left], high[left], entry[left], (slot[left] + (self.high[slot[left]] != 0)) & (SLOTS - 1)

    def _learn(self, low: np.ndarray, high: np.ndarray) -> None:
        """Remember distinct pieces."""
        sizes = (high >> _U(56)).astype(np.int64)
        data = np.stack((low, high)).astype("<u8").view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1).reshape(16, -1)[: int(sizes.max())]
        library = ((data == 0xC4) | (data == 0xC5)).any(0)  # letters whose lower case is left to the tokenizer
        place = np.arange(len(data))[:, None]
        symbols = np.where(place < sizes - 1, self.inner[data], np.where(place == sizes - 1, self.last[data], np.uint16(PAD)))
        plain = ~library
        made, counts = self.merges.merged(symbols[:, plain], sizes[plain])
        ids = made.T[np.arange(len(made)) < counts[:, None]]
        self._store(low[plain], high[plain], self._add(ids, counts))
        if library.any():
            at = np.flatnonzero(library)
            words = [data[: sizes[i], i].tobytes().decode() for i in at]
            self._store(low[at], high[at], self._library(words))

    def _library(self, words: list[str]) -> np.ndarray:
        found = [np.array(e.ids, np.uint16) for e in self.model.encode_batch_fast(words, add_special_tokens=False)]
        return self._add(np.concatenate(found) if found else np.zeros(0, np.uint16), np.array([len(f) for f in found], np.int64))

    # --- texts ----------------------------------------------------------------------------------

    def encode_slice(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other and without end ids; number of ids of each) of UTF-8 bytes."""
        if self.entries > WORDS or len(self.known) > WORDS:
            self._forget()
        n = len(offsets) - 1
        folded, classes, odd = classified(offsets, data)
        starts, sizes = cut(offsets, folded, classes)
        entry = self._entries(folded, starts, sizes)
        counts = self.count[entry]
        total = int(counts.sum())
        shift = self.start[entry] - (np.cumsum(counts) - counts)
        ids = self.pool[np.repeat(shift, counts) + np.arange(total)]
        bounds = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[np.searchsorted(starts, offsets)]
        if not len(odd):
            return ids, np.diff(bounds)
        per = np.diff(bounds)
        raw = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace") for i in odd]
        parts, at = [], 0
        for i, own in zip(odd.tolist(), self._by_words(raw), strict=True):
            parts += [ids[at : bounds[i]], own]
            at, per[i] = bounds[i + 1], len(own)
        assert n == len(per)
        return np.concatenate([*parts, ids[at:]]), per

    def _entries(self, folded: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        short = sizes <= SHORT
        wide = np.concatenate((folded, np.zeros(16, np.uint8)))
        eight = np.ndarray((len(folded) + 8,), "<u8", wide.data, 0, (1,))  # the eight bytes from every place on
        at, n = starts[short], sizes[short]
        low = eight[at] & _FIRST[np.minimum(n, 8)]
        high = (eight[at + 8 * (n > 8)] & _FIRST[np.maximum(n - 8, 0)]) | n.astype(np.uint64) << _U(56)
        found = self._find(low, high)
        new = np.flatnonzero(found < 0)
        while len(new):
            # one of each name; names that differ but agree in this hash wait for the next round
            one = new[np.unique(_mixed(low[new], high[new]), return_index=True)[1]]
            self._learn(low[one], high[one])
            found[new] = self._find(low[new], high[new])
            new = new[found[new] < 0]
        out = np.empty(len(starts), np.int32)
        out[short] = found
        long = np.flatnonzero(~short)
        words = [folded[a : a + k].tobytes() for a, k in zip(starts[long].tolist(), sizes[long].tolist(), strict=True)]
        if unknown := sorted(set(words) - self.long.keys()):
            self.long.update(zip(unknown, self._library([w.decode() for w in unknown]).tolist(), strict=True))
        out[long] = [self.long[w] for w in words]
        return out

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        split = [pieces(t) for t in texts]
        if new := sorted(set().union(*split) - self.known.keys()):
            for w, e in zip(new, self.model.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.known[w] = np.array(e.ids, np.uint16)
        none = np.zeros(0, np.uint16)
        return [np.concatenate([self.known[w] for w in words]) if words else none for words in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        out: list[np.ndarray] = []
        for _, _, offsets, data in text_slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])):
            ids, counts = self.encode_slice(offsets, data)
            out += np.split(ids, np.cumsum(counts)[:-1])
        return out


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it is printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _mixed(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = (low * _U(0x9E3779B97F4A7C15)) ^ (high * _U(0xC2B2AE3D27D4EB4F))
    return (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)


def _slots(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (_mixed(low, high) >> _U(64 - SLOT_BITS)).astype(np.int64)


def classified(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, class of each, texts that hold what the classes leave out; their bytes become spaces)."""
    folded, classes = _LOWER[data], _CLASS[data]
    bad = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else np.zeros(0, np.int64)  # <| of special tokens
    beyond = np.flatnonzero(data >= 0x80)
    if len(beyond):
        wide = np.concatenate((data, np.zeros(2, np.uint8)))
        here, then, third = wide[beyond], wide[beyond + 1], wide[beyond + 2]
        letter = ((here == 0xC3) & (then != 0x97) & (then != 0xB7)) | ((here == 0xC4) & (then != 0xB0)) | (here == 0xC5)
        two = letter | ((here == 0xC2) & ((then == 0xAB) | (then == 0xBB)))
        three = (here == 0xE2) & (then == 0x80) & (third >= 0x90) & (third <= 0xA7)
        for lead, more in ((two, 1), (three, 1), (three, 2)):
            at = beyond[lead]
            classes[at + more] = classes[at]
        capital = beyond[(here == 0xC3) & (then <= 0x9E) & letter] + 1
        folded[capital] += 0x20
        bad = np.concatenate((bad, beyond[(here >= 0xC0) & ~two & ~three]))
    if not len(bad):
        return folded, classes, bad
    odd = np.unique(np.searchsorted(offsets, bad, "right") - 1)
    for i in odd:
        folded[offsets[i] : offsets[i + 1]], classes[offsets[i] : offsets[i + 1]] = 0x20, _SPACE
    return folded, classes, odd


def cut(offsets: np.ndarray, folded: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of every piece: contractions, runs of letters, single digits, runs of signs."""
    n = len(folded)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(classes[1:], classes[:-1], out=start[1:n])
    start[:n] |= classes == _DIGIT
    start[offsets] = True
    wide = np.concatenate((folded, np.zeros(3, np.uint8)))
    apostrophe = np.flatnonzero((folded == 0x27) & start[:n])
    text_end = offsets[np.searchsorted(offsets, apostrophe, "right")]
    one, two = wide[apostrophe + 1], wide[apostrophe + 2]
    lone = apostrophe + 1 < text_end
    short = lone & _ENDS[one]
    long = lone & (apostrophe + 2 < text_end) & (((two == 0x65) & ((one == 0x72) | (one == 0x76))) | ((one == 0x6C) & (two == 0x6C)))
    start[apostrophe[short | long] + 1] = False
    start[apostrophe[short] + 2] = True
    start[apostrophe[long] + 3] = True
    bounds = np.flatnonzero(start)
    inside = classes[bounds[:-1]] != _SPACE
    return bounds[:-1][inside], np.diff(bounds)[inside]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack(ordinal: int, sequence: int, keys: list[int | None], counts: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """The bytes of a file."""
    docs = np.array([[0 if k is None else k, k is not None, n] for k, n in zip(keys, counts, strict=True)], "<i8").tobytes()
    docs = zstandard.compress(docs, 3)
    blocks = [rangecoder.encode(ids[at : at + BLOCK_IDS], vocabulary) for at in range(0, len(ids), BLOCK_IDS)]
    return b"".join([_HEAD.pack(MAGIC, ordinal, sequence, len(keys), len(docs), zlib.crc32(docs), len(blocks)), docs, *blocks])


def unpack(data: bytes) -> tuple[int, int, list[int | None], np.ndarray, np.ndarray]:
    """(ordinal, sequence, keys, ids per document, ids) of a file."""
    magic, ordinal, sequence, n, size, check, blocks = _HEAD.unpack_from(data)
    docs = data[_HEAD.size : _HEAD.size + size]
    if magic != MAGIC or zlib.crc32(docs) != check:
        raise ValueError("not a file of ids, or a damaged one")
    rows = np.frombuffer(zstandard.decompress(docs), "<i8").reshape(n, 3)
    view, at, ids = memoryview(data), _HEAD.size + size, []
    for _ in range(blocks):
        part, used = rangecoder.decode(view[at:])
        ids.append(part)
        at += used
    return ordinal, sequence, [int(k) if some else None for k, some, _ in rows.tolist()], rows[:, 2], np.concatenate(ids) if ids else np.zeros(0, np.uint16)


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", model: str | None = None) -> None:
    """Files of the ids of all rows, each text's followed by the end id, in the folder ``path``."""
    model = model or tokenizer_file()
    chosen = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = chosen.repartitionByRange("key").sortWithinPartitions("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ordinal, sequence = word_ids(model), TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        counts: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def file() -> pa.RecordBatch:
            data = pack(ordinal, sequence, keys, counts, np.concatenate(parts), words.vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["file"])

        for batch in batches:
            for a, b, offsets, data in text_slices(batch):
                ids, each = words.encode_slice(offsets, data)
                at = np.cumsum(each)
                ids = np.insert(ids, at, END)
                at += np.arange(1, len(each) + 1)
                own, done = batch.column(0).slice(a, b - a).to_pylist(), 0
                while done < b - a:  # up to the document that fills the file
                    base = int(at[done - 1]) if done else 0
                    to = min(int(np.searchsorted(at, base + FILE_IDS - held, "left")) + 1, b - a)
                    keys += own[done:to]
                    counts += (each[done:to] + 1).tolist()
                    parts.append(ids[base : at[to - 1]])
                    held, done = held + int(at[to - 1]) - base, to
                    if held >= FILE_IDS:
                        yield file()
                        keys, counts, parts, held, sequence = [], [], [], 0, sequence + 1
        if keys:
            yield file()
        del parts
        give_back()

    files = ordered.mapInArrow(encode, "file binary")
    files.select(F.col("file").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids_crc32 of each document in a folder of files."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                ordinal, sequence, keys, counts, ids = unpack(content.as_py())
                ends = np.cumsum(counts)
                wide = ids.astype("<u4")
                checks = [zlib.crc32(wide[b - n : b].tobytes()) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                k = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([ordinal] * k, pa.int64()), pa.array([sequence] * k, pa.int64()), pa.array(keys, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(checks, pa.int64())], ["ordinal", "sequence", key, "_at", "n_tokens", "ids_crc32"])
        give_back()

    rows = written(files.mapInArrow(decode, f"ordinal bigint, sequence bigint, `{key}` bigint, _at bigint, n_tokens bigint, ids_crc32 bigint"), "read-ids")
    # one row per file: how many ids all earlier files hold
    sizes = rows.groupBy("ordinal", "sequence").agg(F.sum("n_tokens").alias("_ids"))
    before = F.sum("_ids").over(Window.orderBy("ordinal", "sequence").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("ordinal", "sequence", F.coalesce(before, F.lit(0)).alias("_base"))
    return rows.join(bases, ["ordinal", "sequence"]).select(key, (F.col("_base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents tokenized, written and read back."""
    path = new_path(spark, "ids")
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path)
