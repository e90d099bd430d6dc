"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

The segmentation of a BPE model is the only path through the lattice of pieces on which every two
neighbours fit, that is, on which merging the two pieces' text gives just these two pieces again. A
neighbour pair weighs 0 if it fits and minus infinity if not, so encoding is the best path in the
max-plus semiring and may be computed from both ends of any cut: the state at a cut is the piece that
reaches or crosses it, and a chunk of text is a matrix of weights from its entry states to its exit
states. Matrices are combined associatively; once the states at all cuts are known, each chunk is
traced back by itself.

Between characters that stand side by side in no piece (such as before a space that follows a
letter) a cut has one state only, and the matrix of the word between two such cuts is one path: short
words' paths come from merging many words side by side, and are kept per worker in a memory of bounded
size. Texts longer than ``GIANT`` characters are cut
there, wherever that is, into chunks that become rows of their own.

Ids equal the library's for models without normalisation (identity), with a dummy prefix and byte
fallback. Cases: null and empty texts have no ids and decode to an empty text; characters outside the
vocabulary become bytes; a U+2581 in a text decodes to a space, as in the library; equal giant texts
are encoded once; repeated rows each get their ids; an empty table gives an empty result; other
columns are carried where asked for.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table, written
from .merges import PAD, Merges

#: Longer texts are split into chunks of this many characters.
GIANT = 32_768
#: Words (twice as many) and piece pairs that a worker remembers.
WORDS, PAIRS = 80_000, 200_000
#: Rows of a batch that are worked on at once.
SLICE = 256
#: Words of up to this many characters are merged side by side.
SHORT = 16
SPACE = "▁"


def model_file(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A BPE model's pieces and the max-plus lattice over them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.score[piece] = i, model.get_score(i)
        self.text = {i: p for p, i in self.ids.items()}
        self.most = max(map(len, self.ids))
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for ch in piece:
                node = node.setdefault(ch, {})
            node[""] = i
        ranked = sorted(self.ids, key=self.score.__getitem__, reverse=True)
        parts = [(self.ids[p[:k]], self.ids[p[k:]], r) for r, p in enumerate(ranked) for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        self.merges = Merges(*np.array(parts).T, np.array([self.ids[p] for p in ranked]))
        scores = [self.score[p] for p in ranked]
        if any(a == b and not (x + y).strip(SPACE) == "" for a, b, x, y in zip(scores, scores[1:], ranked, ranked[1:], strict=False) if len(x) > 1 < len(y)):
            raise ValueError("pieces other than runs of spaces have equal scores")
        self.tied = 2 * SPACE
        single = {ord(p): i for p, i in self.ids.items() if len(p) == 1}
        self.symbol = np.full(max(single) + 2, PAD, np.uint16)
        self.symbol[list(single)] = list(single.values())
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    # --- neighbours --------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.text[a], self.text[b]
            known = self.pairs[key] = self.merged(x + y) == [x, y]
        return known

    def whole(self, k: int) -> bool:
        """Whether a piece's own text gives just this piece."""
        known = self.alone.get(k)
        if known is None:
            known = self.alone[k] = self.merged(self.text[k]) == [self.text[k]]
        return known

    def starting(self, text: str, i: int, end: int) -> Iterator[tuple[int, int]]:
        """(end, id) of every piece of ``text`` that starts at i."""
        for j in range(i + 1, min(end, i + self.most) + 1):
            part = text[i:j]
            if part not in self.starts:
                return
            if (k := self.ids.get(part)) is not None:
                yield j, k

    # --- words between cuts that have one state ------------------------------------------------

    def path(self, text: str) -> list[int]:
        """The fitting path through a text whose both ends are free cuts."""
        n, pairs = len(text), self.pairs
        ends: list[dict[int, tuple[int, int]] | None] = [None] * (n + 1)
        ends[0] = {-1: (0, -1)}
        for i in range(n):
            before = ends[i]
            if before is None:
                continue
            node = self.trie
            for j in range(i + 1, n + 1):
                node = node.get(text[j - 1])
                if node is None:
                    break
                k = node.get("")
                here = ends[j]
                if k is None or (here is not None and k in here):
                    continue
                for a in before:
                    ok = self.whole(k) if a < 0 else pairs.get(a << 20 | k)
                    if ok is None:
                        ok = self.fits(a, k)
                    if ok:
                        if here is None:
                            here = ends[j] = {}
                        here[k] = (i, a)
                        break
        return self._back(ends, n, next(iter(ends[n])))

    @staticmethod
    def _back(ends: list, at: int, k: int) -> list[int]:
        out = []
        while k >= 0:
            out.append(k)
            at, k = ends[at][k]
        return out[::-1]

    def word(self, word: str) -> bytes:
        """Ids (16 bits each) of a stretch between free cuts: split further where cuts are free."""
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inner]
        if not cuts:
            return self._part(word)
        out = []
        for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True):
            part = word[a:b]
            known = self.words.get(part) or self.older.get(part)
            if known is None:
                known = self.words[part] = self._part(part)
            out.append(known)
        return b"".join(out)

    def _part(self, part: str) -> bytes:
        if len(part) > 1:
            ids = self.path(part)
        else:
            ids = [self.ids[part]] if part in self.ids else [self.byte[b] for b in part.encode()]
        return np.array(ids, np.uint16).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self._joined([split_words(t) if t else [] for t in texts])

    def _joined(self, texts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as their words."""
        if len(self.words) >= WORDS:  # words that come again move over from the older half
            self.older, self.words = self.words, {}
        known, older = self.words, self.older
        asked = set().union(*texts) - known.keys()
        again = asked & older.keys()
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        self._learn(list(asked - again))
        return [b"".join(map(known.__getitem__, words)) for words in texts]

    def _learn(self, words: list[str]) -> None:
        """Remember words: short ones of known characters are merged side by side, others by the lattice.

        Runs of spaces are pieces of one and the same score, which the table of merges does not tell apart.
        """
        short = [w for w in words if len(w) <= SHORT and self.tied not in w]
        rest = [w for w in words if len(w) > SHORT or self.tied in w]
        if short:
            sizes = np.fromiter(map(len, short), np.int64, len(short))
            points = np.frombuffer("".join(short).encode("utf-32-le", "surrogatepass"), "<u4")
            symbols = self.symbol[np.minimum(points, len(self.symbol) - 1)]
            first = np.cumsum(sizes) - sizes
            whole = np.add.reduceat(symbols == PAD, first, dtype=np.int64) == 0
            columns = np.full((int(sizes.max()), len(short)), PAD, np.uint16)
            columns[np.arange(len(symbols)) - np.repeat(first, sizes), np.repeat(np.arange(len(short)), sizes)] = symbols
            made, counts = self.merges.merged(columns[:, whole], sizes[whole])
            ids, stops = made.T[np.arange(len(made)) < counts[:, None]].tobytes(), (2 * np.cumsum(counts)).tolist()
            found = map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops))
            self.words.update(zip((w for w, ok in zip(short, whole.tolist(), strict=True) if ok), found, strict=False))
            rest += [w for w, ok in zip(short, whole.tolist(), strict=True) if not ok]
        for w in rest:
            self.words[w] = self.word(w)

    # --- chunks of giant texts ----------------------------------------------------------------

    def states(self, text: str, cut: int) -> list[tuple[int, int, int]]:
        """(start, end, id) of every piece, or lone outside character, that reaches or crosses a cut."""
        found = []
        for i in range(max(0, cut - self.most), cut):
            found += [(i, j, k) for j, k in self.starting(text, i, len(text)) if j >= cut]
        if cut and text[cut - 1] not in self.ids:
            found.append((cut - 1, cut, -1))
        return found

    def _next(self, text: str, i: int, end: int) -> list[tuple[int, int]]:
        return list(self.starting(text, i, end)) if text[i] in self.ids else [(i + 1, -1)]

    def _fit(self, a: int, b: int) -> bool:
        """Characters outside the vocabulary (-1) are in no piece, so they fit with everything."""
        return a < 0 or b < 0 or self.fits(a, b)

    def chunk(self, text: str, start: int, end: int, first: bool, last: bool, entries: list[tuple[int, int, int]]) -> list[dict[int, tuple[int, int, int]]]:
        """For each position, the pieces that end there: id -> (mask of entries, previous end, previous id)."""
        ends: list[dict[int, tuple[int, int, int]]] = [{} for _ in range(len(text) + 1)]
        for x, (_, j, k) in enumerate(entries):
            mask = ends[j].get(k, (0, 0, 0))[0]
            ends[j][k] = (mask | 1 << x, -1, -1)
        for i in range(start, end):
            before = ends[i]
            if not before and not (first and i == start):
                continue
            for j, k in self._next(text, i, len(text)):
                mask, previous = (1, (-1, -2)) if first and i == start else (0, (-1, -2))
                if first and i == start and k >= 0 and not self.whole(k):
                    continue
                for a, (m, _, _) in before.items():
                    if self._fit(a, k):
                        mask |= m
                        previous = (i, a)
                if mask:
                    old = ends[j].get(k)
                    ends[j][k] = (mask | old[0], old[1], old[2]) if old else (mask, *previous)
        return ends

    def free(self, text: str, start: int, end: int) -> tuple[int, int] | None:
        """(first, last) cut strictly inside a chunk that no piece crosses; None if there is none."""
        low = next((c for c in range(start + 1, end) if text[c - 1 : c + 1] not in self.inner), None)
        return None if low is None else (low, next(c for c in range(end - 1, start, -1) if text[c - 1 : c + 1] not in self.inner))

    def transfer(self, text: str, start: int, end: int, first: bool, last: bool) -> np.ndarray:
        """Max-plus weights (0 or minus infinity) from entry states to exit states.

        At a cut that no piece crosses all states are one, so only the stretches before the first and
        behind the last such cut are searched; in between there is one path whatever comes before.
        """
        entries = [] if first else self.states(text, start)
        exits = [(end, end, None)] if last else self.states(text, end)
        cuts = self.free(text, start, end)
        if cuts is None:
            return self._weights(self.chunk(text, start, end, first, last, entries), max(1, len(entries)), exits)
        head = self._weights(self.chunk(text, start, cuts[0], first, False, entries), max(1, len(entries)), [(cuts[0], cuts[0], None)])
        tail = self._weights(self.chunk(text, cuts[1], end, True, last, []), 1, exits)
        return product(head, tail)

    @staticmethod
    def _weights(ends: list, rows: int, exits: list[tuple]) -> np.ndarray:
        out = np.full((rows, len(exits)), -np.inf)
        for y, (_, j, k) in enumerate(exits):
            for mask in [v[0] for v in ends[j].values()] if k is None else [ends[j].get(k, (0,))[0]]:
                for x in range(rows):
                    if mask >> x & 1:
                        out[x, y] = 0.0
        return out

    def trace(self, text: str, start: int, end: int, first: bool, last: bool, entry: int, leave: int) -> bytes:
        """Ids of the pieces that start in a chunk, given its states."""
        entries = [] if first else [self.states(text, start)[entry]]
        goal = None if last else self.states(text, end)[leave][1:]
        cuts = self.free(text, start, end)
        if cuts is None:
            return self._trace(text, start, end, first, last, entries, goal)
        middle = _ESCAPED.findall(text[cuts[0] : cuts[1]])
        return self._trace(text, start, cuts[0], first, True, entries, None) + self._joined([middle])[0] + self._trace(text, cuts[1], end, True, last, [], goal)

    def _trace(self, text: str, start: int, end: int, first: bool, last: bool, entries: list, goal: tuple[int, int] | None) -> bytes:
        ends = self.chunk(text, start, end, first, last, entries)
        j, k = goal or (end, next(iter(ends[end])))
        out: list[tuple[int, int]] = []
        while k != -2 and not (entries and (j, k) == entries[0][1:] and ends[j][k][1] == -1):
            _, i, a = ends[j][k]
            out.append((i if i >= 0 else start, k))
            j, k = i, a
        ids: list[int] = []
        for i, k in reversed(out):
            ids += [k] if k >= 0 else [self.byte[b] for b in text[i].encode()]
        return np.array(ids, np.uint16).tobytes()


def split_words(text: str) -> list[str]:
    """Stretches of an escaped text between cuts before a space after something else, and around line ends."""
    return _ESCAPED.findall(SPACE + text.replace(" ", SPACE))


_ESCAPED = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def raw_pieces(path: str) -> list[bytes]:
    """The bytes that each id stands for: all that decoding needs of a model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        silent = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if silent else piece.replace(SPACE, " ").encode())
    return out


def text_of(ids: np.ndarray, raw: list[bytes]) -> bytes:
    whole = b"".join(map(raw.__getitem__, ids.tolist()))
    return whole[1:] if whole[:1] == b" " else whole


def forget() -> None:
    """Drop models and what they remember at the end of a task: idle workers would hold it beside the next stage's."""
    pieces.cache_clear()
    raw_pieces.cache_clear()
    give_back()


# --- max-plus algebra -------------------------------------------------------------------------------


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(1)


def scan(matrices: list[np.ndarray]) -> list[int]:
    """The state at each inner cut on the best path through all chunks, by products of prefixes and suffixes."""
    before = [matrices[0]]
    for m in matrices[1:-1]:
        before.append(product(before[-1], m))
    after = [matrices[-1]]
    for m in reversed(matrices[1:-1]):
        after.append(product(m, after[-1]))
    return [int((left[0] + right[:, 0]).argmax()) for left, right in zip(before, reversed(after), strict=True)]


# --- Spark ------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), path: str | None = None, giant: int = GIANT) -> DataFrame:
    """key, ``carry``, ids (16 bits each, little-endian) of every row."""
    path = path or model_file()
    most = pieces(path).most
    chosen = docs.select(F.col(key), *carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = [key, *carry, "ids"]
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in (key, *carry)) + ", ids binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = pa.array(model.encode(part.column(len(names) - 1).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names)
        del model
        forget()

    short = chosen.where(F.length("_text") <= giant).mapInArrow(encode, schema)

    # Chunks of the distinct giant texts, with as much of their surroundings as a piece can reach.
    whole = chosen.where(F.length("_text") > giant).withColumn("_sha", F.sha2("_text", 256))
    escaped = F.concat(F.lit(SPACE), F.translate("_text", " ", SPACE))
    once = whole.select("_sha", escaped.alias("_text")).dropDuplicates(["_sha"]).withColumn("_n", F.length("_text"))
    cut = once.select("_sha", "_n", "_text", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_n") / giant).cast("int") - 1)).alias("k"))
    low = F.greatest(F.col("k") * giant - most, F.lit(0))
    start, end = F.col("k") * giant, F.least((F.col("k") + 1) * giant, F.col("_n"))
    chunks = cut.select("_sha", "k", F.substring("_text", low + 1, end - low + most).alias("part"), (start - low).alias("start"), (end - low).alias("stop"), (F.col("k") == 0).alias("first"), (end == F.col("_n")).alias("last"))
    chunks = written(chunks, "chunks")

    def weigh(frames):
        model = pieces(path)
        for f in frames:
            made = [model.transfer(*r) for r in f[["part", "start", "stop", "first", "last"]].itertuples(index=False, name=None)]
            yield f[["_sha", "k"]].assign(rows=[m.shape[0] for m in made], weights=[m.tobytes() for m in made])
        del model
        forget()

    def choose(f):
        f = f.sort_values("k")
        states = scan([np.frombuffer(w).reshape(r, -1) for r, w in zip(f["rows"], f["weights"], strict=True)])
        return f[["_sha", "k"]].assign(entry=[0, *states], leave=[*states, 0])

    def trace(frames):
        model = pieces(path)
        for f in frames:
            made = [model.trace(*r) for r in f[["part", "start", "stop", "first", "last", "entry", "leave"]].itertuples(index=False, name=None)]
            yield f[["_sha", "k"]].assign(ids=made)
        del model
        forget()

    def join(f):
        import pandas as pd  # only in tasks that need it: workers of other stages stay smaller

        return pd.DataFrame({"_sha": [f["_sha"].iloc[0]], "ids": [b"".join(f.sort_values("k")["ids"])]})

    weights = chunks.mapInPandas(weigh, "_sha string, k int, rows int, weights binary")
    states = weights.groupBy("_sha").applyInPandas(choose, "_sha string, k int, entry int, leave int")
    traced = chunks.join(states, ["_sha", "k"]).mapInPandas(trace, "_sha string, k int, ids binary")
    joined = traced.groupBy("_sha").applyInPandas(join, "_sha string, ids binary")
    return short.unionByName(whole.select(key, *carry, "_sha").join(joined, "_sha").select(*names))


def decoded(tokens: DataFrame, carry: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """``carry``, ids and the text they stand for."""
    path = path or model_file()
    chosen = tokens.select(*carry, "ids")
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in carry) + ", n_pieces bigint, ids_crc32 bigint, ids_sha256 string, text string"
    names = [*carry, "n_pieces", "ids_crc32", "ids_sha256", "text"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_of = raw_pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                raw = part.column(len(carry)).to_pylist()
                texts = [text_of(np.frombuffer(r, np.uint16), table_of).decode("utf-8", "replace") for r in raw]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(texts, pa.string())], names)
        del table_of
        forget()

    return chosen.mapInArrow(decode, schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """key, n_pieces, ids_crc32 and ids_sha256 (of the 16-bit ids), text_sha256 (decoded), lossless.

    With ``stored``, ids are written before they are decoded, so that a task has one Python worker at a time, not two.
    """
    marked = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_before", F.sha2("_t", 256))
    ids = encoded(marked, key, "_t", ("_before",))
    back = decoded(written(ids, "ids") if stored else ids, (key, "_before"))
    after = F.sha2("text", 256)
    return back.select(key, "n_pieces", "ids_crc32", "ids_sha256", after.alias("text_sha256"), (after == F.col("_before")).alias("lossless"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return round_trip(table(spark, sf_dir, "documents"))
