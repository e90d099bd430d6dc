"""A compressed index of sequences of words for backward search: wavelet tree, boundaries of depth, least owners.

The index of a shard keeps, in suffix order, the symbol before each suffix (the Burrows-Wheeler transform)
as a wavelet tree of packed bits with counts per 64 of them, a bit where a suffix differs from the one before
within ``depth`` symbols, and the least owner of each group of suffixes between such bits. The sequences and
the suffix order themselves are dropped.

Streams are matched from their last symbol to the first. A step extends all streams' matches by the symbol
before, which narrows their suffix intervals by two ranks in the tree; a match longer than ``depth`` is cut back
to it, which widens its interval to the group it lies in. Suffixes are sorted to ``2p > depth`` symbols only, by
doubling: an interval's bounds need no finer order.
"""

from __future__ import annotations

import numpy as np

#: An owner larger than any.
NONE = np.iinfo(np.int64).max
_M = np.uint64


class Bits:
    """Packed bits with the number of ones before each block of 64."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros(len(bits) // 64 * 8 + 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.blocks = packed.view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """How many ones there are before each place."""
        block = at >> 6
        low = (_M(1) << (at & 63).astype(np.uint64)) - _M(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & low)


class WaveletTree:
    """Ranks of symbols in a sequence, one row of bits per bit of a symbol, zeros before ones in the row below."""

    def __init__(self, sequence: np.ndarray, symbols: int) -> None:
        self.levels: list[tuple[Bits, int, int]] = []
        for shift in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> shift & 1).astype(bool)
            self.levels.append((Bits(bit), shift, int(len(bit) - bit.sum())))
            sequence = np.concatenate((sequence[~bit], sequence[bit]))
        self.start = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bits, shift, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.start[symbol]


def _named(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].reshape(-1)


def _shifted(names: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros(len(names), np.int64)
    out[: max(0, len(names) - by)] = names[by:] + 1
    return out


def order_of(sequence: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in the order of more than ``depth`` symbols, whether each differs from the one before within ``depth``)."""
    names, reach = _named(sequence), 1
    while 2 * reach < depth + 1:
        names = _named(names * (len(names) + 1) + _shifted(names, reach))
        reach *= 2
    order = np.argsort(names * (len(names) + 1) + _shifted(names, reach), kind="stable")
    whole = (names * (len(names) + 1) + _shifted(names, depth - reach))[order] if depth > reach else names[order]
    return order, np.concatenate(([True], whole[1:] != whole[:-1]))


class FmIndex:
    """The index of sequences that lie one after the other, each ended by symbol 0; owners are given per symbol."""

    def __init__(self, sequence: np.ndarray, owners: np.ndarray, depth: int) -> None:
        order, new = order_of(sequence, depth)
        self.depth, self.symbols = depth, int(sequence.max()) + 1
        self.tree = WaveletTree(sequence[order - 1], self.symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=self.symbols))))
        self.groups, self.starts = Bits(new), np.append(np.flatnonzero(new), len(sequence))
        self.least = np.minimum.reduceat(owners[order], self.starts[:-1])

    def extended(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of matches with a symbol more in front."""
        both = self.first[np.tile(symbol, 2)] + self.tree.rank(np.tile(symbol, 2), np.concatenate((low, high)))
        return both[: len(symbol)], both[len(symbol) :]

    def group(self, low: np.ndarray) -> np.ndarray:
        """Which group of suffixes that agree on ``depth`` symbols a suffix is in."""
        return self.groups.ones(low + 1) - 1

    def least_owners(self, stream: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each place of a stream of indexed sequences, the least owner of the ``depth`` symbols there.

        Where a sequence ends before, and the matching statistic is less than ``depth``, the largest integer is given.
        offsets: where each sequence starts, and the end.
        """
        out = np.full(len(stream), NONE, np.int64)
        lengths = np.diff(offsets)
        longest_first = np.argsort(-lengths, kind="stable")
        ends, lengths = offsets[1:][longest_first], lengths[longest_first]
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), int(self.first[-1]), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            active = int(np.searchsorted(-lengths, -step, "right"))
            at = ends[:active] - step
            low, high = self.extended(stream[at], low[:active], high[:active])
            if (low >= high).any():
                raise ValueError("a stream is not in the index")
            if step >= self.depth:
                group = self.group(low)
                low, high = self.starts[group], self.starts[group + 1]
                out[at] = self.least[group]
        return out
