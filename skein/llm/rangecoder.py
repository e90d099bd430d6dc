"""Adaptive context-mixing range coder for blocks of token ids.

A block is coded by itself: its models start anew and a checksum covers its ids. Its ids are cut into
lanes of equal length, which are coded side by side, one id of each lane in a step, by one carryless
range coder per lane; numpy does a step for all lanes at once.

An id is predicted by three distributions that all lanes share and that learn after every ``CHUNK``
steps: the frequencies of all ids so far (order 0), what followed the id before (order 1, kept as its
last two different successors) and the two ids before (order 2, kept as the last successor). They are
mixed linearly: the probability of an id is the weighted sum of what the distributions give it, and so
is the cumulative probability that its interval starts from, so an id has one interval whichever of
them know it. The weights are learnt per context (how often the last successors of both orders held,
and whether they agree) from each part's share in the ids that came (online expectation maximisation,
in which order 0 counts for the ids that no successor gave).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, LEAST_LANE, CHUNK = 4096, 128, 4
#: Bits of a weight, of the order-0 frequencies (30 together, so that products are 32-bit), and of the order-2 table's slots.
WEIGHT_BITS, ID_BITS, HASH_BITS = 11, 19, 18
TOTAL_BITS = WEIGHT_BITS + ID_BITS
#: Parts that are mixed: the successor of order 2, two successors of order 1, and order 0.
PARTS, LEAST_WEIGHT = 4, 4
#: Which parts gave an id, for each of the eight patterns.
_KNOWN = np.array([[p >> 2 & 1 for p in range(8)], [p >> 1 & 1 for p in range(8)], [p & 1 for p in range(8)]])
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 40)
_HEAD = struct.Struct("<IIIII")


class Models:
    """What has been learnt of a block so far.

    A context's entry packs its last successor, the different one before that, how often the last one held in a
    row (0: no successor yet) and, in order 2, the part of the hashed pair of ids that its slot does not tell.
    """

    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        self.seen = np.zeros(vocabulary, np.int64)
        self.order1, self.order2 = np.zeros(vocabulary, np.uint64), np.zeros(1 << HASH_BITS, np.uint64)
        self.shares = np.tile(np.array([1.0, 1.0, 0.3, 12.0]), (128, 1))
        self.learnt = 0
        self._frequencies()
        self._weights()

    def _frequencies(self) -> None:
        total = int(self.seen.sum())
        spare = (1 << ID_BITS) - self.vocabulary
        width = 1 + (self.seen * spare // total if total else np.full(self.vocabulary, spare // self.vocabulary))
        width[0] += (1 << ID_BITS) - int(width.sum())
        self.width = width.astype(np.int32)
        self.edge = (np.cumsum(width) - width).astype(np.int32)
        self.id_at = np.repeat(np.arange(self.vocabulary, dtype=np.uint16), width)

    def _weights(self) -> None:
        part = self.shares / self.shares.sum(1, keepdims=True)
        weight = (part * ((1 << WEIGHT_BITS) - PARTS * LEAST_WEIGHT)).astype(np.int32) + LEAST_WEIGHT
        weight[:, -1] = (1 << WEIGHT_BITS) - weight[:, :-1].sum(1)
        self.rest = weight[:, -1].copy()
        self.widths = np.ascontiguousarray(weight[:, :-1].T) << ID_BITS

    def predict(self, before: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, ...]:
        """(three successors, context of the weights, slot, order-2 check) after some pairs of ids."""
        h = (before.astype(np.uint32) << np.uint32(16) | earlier) * np.uint32(0x9E3779B1)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)  # a bijection of the pair
        slot, check = h >> np.uint32(32 - HASH_BITS), h & np.uint32((1 << 32 - HASH_BITS) - 1)
        two, one = self.order2[slot], self.order1[before]
        near2, near1, far1 = two.astype(np.uint16), one.astype(np.uint16), (one >> _U(16)).astype(np.uint16)
        held2 = (two >> _U(32)).astype(np.uint32)
        run2 = np.where(held2 >> np.uint32(4) == check, held2 & np.uint32(7), np.uint32(0))
        gate = (run2 << np.uint32(4) | (one >> _U(31)).astype(np.uint32) & np.uint32(14) | (near1 == near2)).astype(np.uint8)
        return near2, near1, far1, gate, slot, check

    def learn(self, ids: np.ndarray, before: np.ndarray, near2: np.ndarray, near1: np.ndarray, far1: np.ndarray, gate: np.ndarray, slot: np.ndarray, check: np.ndarray) -> None:
        """Take in some ids: what followed, and which parts had known it."""
        self.seen += np.bincount(ids, minlength=self.vocabulary)
        is2, is1, was1 = near2 == ids, near1 == ids, far1 == ids
        pattern = is2 * np.uint16(4) + is1 * np.uint16(2) + was1
        cells = np.bincount(gate * np.uint16(8) + pattern, minlength=1024).reshape(128, 8)
        # an id that several parts gave counts for each by its weight; order 0 counts for those that no other part gave
        weight = self.widths[:, :, None] * _KNOWN[:, None, :]
        self.shares[:, :-1] += (weight / np.maximum(weight.sum(0), 1) * cells).sum(2).T
        self.shares[:, -1] += cells[:, 0]
        wide = ids.astype(np.uint64)
        for table, at, near, far, same, held, extra in (
            (self.order1, before, near1, far1, is1, gate >> 1 & 7, None),
            (self.order2, slot, near2, near2, is2, gate >> 4, check),
        ):
            same = same & (held > 0)
            high = np.where(same, np.minimum(held + 1, 7), 1).astype(np.uint64)
            if extra is not None:
                high |= extra.astype(np.uint64) << _U(4)
            table[at] = wide | np.where(same, far, near).astype(np.uint64) << _U(16) | high << _U(32)
        self.learnt += 1
        if self.learnt & (self.learnt - 1) == 0 or self.learnt % 16 == 0:
            self._frequencies()
        self._weights()


def _lanes(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_LANE))
    return lanes, -(-n // lanes)


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: header (ids, vocabulary, checksum of the ids, bytes, checksum of the bytes), words per lane, words."""
    n = len(ids)
    ids = ids.astype(np.uint16)
    lanes, steps = _lanes(n)
    text = np.zeros(lanes * steps, np.uint16)
    text[:n] = ids
    text = np.ascontiguousarray(text.reshape(lanes, steps).T)
    models = Models(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _U(2**64 - 1))
    words: list[np.ndarray] = []
    whose: list[np.ndarray] = []
    before, earlier = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
    for at in range(0, steps, CHUNK):
        part = text[at : at + CHUNK]
        b = np.concatenate((before[None], part[:-1]))
        e = np.concatenate((earlier[None], b[:-1]))
        flat, context = part.reshape(-1), b.reshape(-1)
        near2, near1, far1, gate, slot, check = models.predict(context, e.reshape(-1))
        rest = models.rest[gate]
        start, width = rest * models.edge[flat], rest * models.width[flat]
        for successor, widths in zip((near2, near1, far1), models.widths, strict=True):
            share = widths[gate]
            start += share * (successor < flat)
            width += share * (successor == flat)
        starts, whole = start.astype(np.uint64).reshape(part.shape), width.astype(np.uint64).reshape(part.shape)
        for k in range(len(part)):
            span >>= _U(TOTAL_BITS)
            low += span * starts[k]
            span *= whole[k]
            while True:
                settled = (low ^ (low + span)) < _TOP
                need = np.flatnonzero(settled | (span < _BOTTOM))
                if not len(need):
                    break
                l, s, t = low[need], span[need], settled[need]
                if not t.all():
                    s = np.where(t, s, (~l + _U(1)) & (_BOTTOM - _U(1)))
                words.append((l >> _U(48)).astype(np.uint16))
                whose.append(need.astype(np.uint16))
                low[need] = l << _U(16)
                span[need] = s << _U(16)
        models.learn(flat, context, near2, near1, far1, gate, slot, check)
        before, earlier = part[-1], (part[-2] if len(part) > 1 else before)
    for shift in (48, 32, 16, 0):
        words.append((low >> _U(shift)).astype(np.uint16))
        whose.append(np.arange(lanes, dtype=np.uint16))
    lane = np.concatenate(whose)
    stream = np.concatenate(words)[np.argsort(lane, kind="stable")].astype("<u2").tobytes()
    sizes = np.bincount(lane, minlength=lanes).astype("<u4").tobytes()
    body = sizes + stream
    return _HEAD.pack(n, vocabulary, zlib.crc32(ids.astype("<u4").tobytes()), len(body), zlib.crc32(body)) + body


def decode(block: bytes | memoryview) -> tuple[np.ndarray, int]:
    """(ids of the block at the start of some bytes, bytes it takes)."""
    n, vocabulary, check, size, body_check = _HEAD.unpack_from(block)
    body = bytes(block[_HEAD.size : _HEAD.size + size])
    if zlib.crc32(body) != body_check:
        raise ValueError("a block's bytes do not have their checksum")
    lanes, steps = _lanes(n)
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    stream = np.concatenate((np.frombuffer(body, "<u2", offset=4 * lanes).astype(np.uint64), np.zeros(1, np.uint64)))
    at_word = np.cumsum(sizes) - sizes
    last = len(stream) - 1
    code = np.zeros(lanes, np.uint64)
    for _ in range(4):
        code = code << _U(16) | stream[at_word]
        at_word += 1
    models = Models(vocabulary)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, _U(2**64 - 1))
    out = np.zeros((steps, lanes), np.uint16)
    before, earlier = np.zeros(lanes, np.uint16), np.zeros(lanes, np.uint16)
    for at in range(0, steps, CHUNK):
        kept = []
        edge, wide = models.edge, models.width
        for k in range(at, min(at + CHUNK, steps)):
            *successors, gate, slot, check_of = models.predict(before, earlier)
            rest = models.rest[gate]
            share = [w[gate] for w in models.widths]
            starts, ends = [rest * edge[c] for c in successors], [rest * wide[c] + w for c, w in zip(successors, share, strict=True)]
            for i, j in ((0, 1), (0, 2), (1, 2)):
                less, same = successors[i] < successors[j], successors[i] == successors[j]
                starts[j] += share[i] * less
                starts[i] += share[j] * ~(less | same)
                ends[i] += share[j] * same
                ends[j] += share[i] * same
            span >>= _U(TOTAL_BITS)
            place = ((code - low) // span).astype(np.int32)
            beyond = place.copy()  # less the successors that lie before the id
            ids, start, whole = np.zeros(lanes, np.uint16), np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
            for c, a, w, b in zip(successors, starts, ends, share, strict=True):
                behind = place >= a + w
                beyond -= b * behind
                hit = (place >= a) & ~behind
                np.copyto(ids, c, where=hit)
                np.copyto(start, a, where=hit)
                np.copyto(whole, w, where=hit)
            miss = np.flatnonzero(whole == 0)
            if len(miss):
                weight, left = rest[miss], beyond[miss]
                found = models.id_at[left // weight]
                ids[miss] = found
                start[miss] = weight * edge[found] + place[miss] - left
                whole[miss] = weight * wide[found]
            low += span * start.astype(np.uint64)
            span *= whole.astype(np.uint64)
            while True:
                settled = (low ^ (low + span)) < _TOP
                need = np.flatnonzero(settled | (span < _BOTTOM))
                if not len(need):
                    break
                l, s, t = low[need], span[need], settled[need]
                if not t.all():
                    s = np.where(t, s, (~l + _U(1)) & (_BOTTOM - _U(1)))
                word = at_word[need]
                code[need] = code[need] << _U(16) | stream[np.minimum(word, last)]
                at_word[need] = word + 1
                low[need] = l << _U(16)
                span[need] = s << _U(16)
            kept.append((ids, before, *successors, gate, slot, check_of))
            out[k] = ids
            before, earlier = ids, before
        models.learn(*(np.concatenate([x[i] for x in kept]) for i in range(8)))
    ids = np.ascontiguousarray(out.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("a block's ids do not have their checksum")
    return ids, _HEAD.size + size
