"""Byte-pair merges of many short words side by side.

A word is a column of symbols. In each round every word that still has a mergeable pair merges its best one
(the least rank, the leftmost of equals), which is what a queue of pairs does for one word at a time.
"""

from __future__ import annotations

import numpy as np

PAD, NONE = 65535, np.int32(2**31 - 1)
_FREE = np.uint32(2**32 - 1)
_SPREAD = np.uint32(0x9E3779B1)


class Merges:
    """Pairs of symbols, the rank of each pair, and the symbol that each rank makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, result: np.ndarray) -> None:
        self.result = result.astype(np.uint16)
        self.shift = np.uint32(32 - max(4, int(4 * len(left)).bit_length()))
        slots = 1 << int(32 - self.shift)
        self.keys, self.ranks = np.full(slots, _FREE), np.full(slots, NONE)
        self.mask = np.uint32(slots - 1)
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot, rank = self._slot(key), rank.astype(np.int32)
        while len(key):
            free = np.flatnonzero(self.keys[slot] == _FREE)
            took = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[took]], self.ranks[slot[took]] = key[took], rank[took]
            rest = np.delete(np.arange(len(key)), took)
            key, rank, slot = key[rest], rank[rest], slot[rest]
            slot = np.where(self.keys[slot] == _FREE, slot, (slot + np.uint32(1)) & self.mask)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key * _SPREAD) >> self.shift

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``NONE`` for pairs that do not merge."""
        key = left.astype(np.uint32) << np.uint32(16) | right
        slot = self._slot(key)
        found = self.keys[slot]
        rank = np.where(found == key, self.ranks[slot], NONE)
        rest = np.flatnonzero((found != key) & (found != _FREE))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint32(1)) & self.mask
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            rank[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (found != _FREE)]
        return rank

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, sizes) after all merges; symbols[i, w] is symbol i of word w, ``PAD`` behind its end."""
        out, left = symbols.copy(), sizes.copy()
        for low, high in ((1, 4), (4, 6), (6, 8), (8, 12), (12, len(symbols))):
            words = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(words):
                out[:high, words], left[words] = self._round(np.ascontiguousarray(symbols[:high, words]), sizes[words].copy())
        return out, left

    def _round(self, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, final = np.empty_like(s), sizes.copy()
        words = np.arange(s.shape[1])
        ranks = np.stack([self.rank_of(s[j], s[j + 1]) for j in range(len(s) - 1)])
        while len(words):
            best, at = ranks[0].copy(), np.zeros(len(words), np.int8)
            for j in range(1, len(ranks)):
                np.copyto(at, j, where=ranks[j] < best)
                np.minimum(best, ranks[j], out=best)
            go = best != NONE
            if not go.all():
                done = ~go
                out[:, words[done]], final[words[done]] = s[:, done], sizes[done]
                words, s, ranks, sizes, best, at = words[go], s[:, go], ranks[:, go], sizes[go], best[go], at[go]
                if not len(words):
                    break
            for j in range(1, len(s)):  # what stands behind the pair moves up by one
                behind = at < j
                np.copyto(s[j], s[j + 1] if j + 1 < len(s) else np.uint16(PAD), where=behind)
                if j < len(ranks):
                    np.copyto(ranks[j], ranks[j + 1] if j + 1 < len(ranks) else NONE, where=behind)
            sizes -= 1
            each, at = np.arange(len(words)), at.astype(np.int64)
            made = self.result[best]
            s[at, each] = made
            after = np.minimum(at + 1, len(s) - 1)
            ranks[np.minimum(at, len(ranks) - 1), each] = np.where(at + 1 < sizes, self.rank_of(made, s[after, each]), NONE)
            some = np.flatnonzero(at > 0)
            ranks[at[some] - 1, some] = self.rank_of(s[at[some] - 1, some], made[some])
        return out, final
