"""External induced suffix sorting with common-prefix values.

Suffixes are sorted as in SA-IS: the leftmost-S suffixes of every descent are sorted first, and all
others are induced from them, L suffixes by one ascending sweep over first symbols and S suffixes by
one descending sweep. Both sweeps draw (suffix, common prefix with the one before) tuples from a
priority queue. Its keys only ever rise (or fall) during a sweep and equal keys leave in the order
they came in, so the queue is one run of tuples per symbol; runs are written to disk when together
they exceed the memory given, and come back as they are due. Tuples move in blocks: numpy finds all
suffixes that a block induces, and the common prefix of two that meet in a bucket is one more than
the least value between their sources.

Prefix values are exact up to ``depth``; the order of suffixes equal up to there is left open, so
names of the reduced problem are refined by doubling until they cover ``depth`` symbols.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 18


class Runs:
    """A monotone priority queue: tuples leave by symbol and, within one, first in first out."""

    def __init__(self, symbols: int, memory: int) -> None:
        self.blocks: list[deque] = [deque() for _ in range(symbols)]
        self.memory, self.held, self.file = memory, 0, None

    def push(self, symbol: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        self.blocks[symbol].append((suffixes, common))
        self.held += suffixes.nbytes + common.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for run in self.blocks:
            for i, block in enumerate(run):
                if isinstance(block[0], np.ndarray):
                    at = self.file.seek(0, 2)
                    block[0].tofile(self.file)
                    block[1].tofile(self.file)
                    run[i] = (at, len(block[0]), block[0].dtype, block[1].dtype)
        self.file.flush()
        self.held = 0

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, a, b = block
        self.file.seek(at)
        return np.fromfile(self.file, a, n), np.fromfile(self.file, b, n)

    def drain(self, symbol: int, backwards: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a symbol in large blocks, those pushed meanwhile included."""
        run = self.blocks[symbol]
        while run:
            parts, n = [], 0
            while run and (not parts or n < BLOCK):
                parts.append(self._load(run.pop() if backwards else run.popleft()))
                n += len(parts[-1][0])
            if backwards:
                parts.reverse()
            yield parts[0] if len(parts) == 1 else (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both included."""
    if not len(low):
        return values[:0]
    width = (high - low + 1).astype(np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    row, h = values, 1
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(row[low[at]], row[high[at] - h + 1])
        if len(row) > h:
            row = np.minimum(row[:-h], row[h:])
        h *= 2
    return out


class Meeting:
    """Common prefixes of neighbours that a stream leaves in each bucket: the least value since the bucket's last one."""

    def __init__(self, buckets: int, depth: int) -> None:
        self.since = np.full(buckets, -1, np.int64)
        self.depth = depth

    def put(self, common: np.ndarray, at: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, starts of groups, least values) of the stream positions ``at`` that go to buckets; -1: the first in a bucket."""
        running = np.minimum.accumulate(common)
        order = np.argsort(bucket, kind="stable")
        at, bucket = at[order], bucket[order]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(at) else np.zeros(0, np.int64)
        least = np.empty(len(at), np.int64)
        inner = np.ones(len(at), bool)
        inner[starts] = False
        inner = np.flatnonzero(inner)
        least[inner] = range_min(common, at[inner - 1] + 1, at[inner])
        heads = self.since[bucket[starts]]
        least[starts] = np.where(heads < 0, -1, np.minimum(heads, running[at[starts]]))
        self.since = np.where(self.since < 0, -1, np.minimum(self.since, running[-1]))
        if len(at):
            lasts = np.concatenate((starts[1:], [len(at)])) - 1
            after = at[lasts] + 1
            rest = np.full(len(lasts), self.depth, np.int64)
            inside = np.flatnonzero(after < len(common))
            if len(inside):
                back = np.minimum.accumulate(common[::-1])[::-1]
                rest[inside] = back[after[inside]]
            self.since[bucket[lasts]] = rest
        return order, starts, least


class Sorter:
    """Suffixes of a sequence of small symbols that ends in 0, which is nowhere else in it."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 64 << 20) -> None:
        self.text, self.depth, self.memory = text, depth, memory
        self.n, self.symbols = len(text), int(text.max()) + 1
        self.index = np.int32 if self.n < 2**31 else np.int64
        self.value = np.uint8 if depth < 255 else np.uint16
        change = np.flatnonzero(text[1:] != text[:-1])
        ends = np.concatenate((change, [self.n - 1]))
        rising = np.concatenate((text[change + 1] > text[change], [True]))
        lengths = np.diff(np.concatenate(([-1], ends)))
        self.small = np.repeat(rising, lengths)  # S type
        left = np.repeat(ends, lengths) - np.arange(self.n) + 1
        self.run = np.minimum(left, depth).astype(self.value)  # equal symbols from here on
        self.stars = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    # --- the two sweeps ------------------------------------------------------------------------

    def _send(self, queue: Runs, meeting: Meeting, suffixes: np.ndarray, common: np.ndarray, keep: np.ndarray, before: np.ndarray) -> None:
        at = np.flatnonzero(keep)
        order, starts, least = meeting.put(common, at, before[at])
        if not len(at):
            return
        made = np.where(least < 0, 0, np.minimum(least + 1, self.depth)).astype(self.value)
        sources = at[order]
        induced = (suffixes[sources] - 1).astype(self.index)
        bounds = np.concatenate((starts, [len(at)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            queue.push(int(before[sources[a]]), induced[a:b], made[a:b])

    def _before(self, suffixes: np.ndarray) -> np.ndarray:
        out = self.text[suffixes - 1].astype(np.int64)
        out[suffixes == 0] = -1
        return out

    def ascending(self, order: np.ndarray, common: np.ndarray) -> Runs:
        """L suffixes by symbol, induced from the star suffixes in order."""
        queue, done, meeting = Runs(self.symbols, self.memory), Runs(self.symbols, self.memory), Meeting(self.symbols, self.depth)
        heads = np.searchsorted(self.text[order], np.arange(self.symbols + 1))
        for c in range(self.symbols):
            last = -1
            for suffixes, values in queue.drain(c):
                before = self._before(suffixes)
                self._send(queue, meeting, suffixes, values, before >= c, before)
                done.push(c, suffixes, values)
                last = int(suffixes[-1])
            for a in range(heads[c], heads[c + 1], BLOCK):
                b = min(a + BLOCK, heads[c + 1])
                suffixes, values = order[a:b], common[a:b]
                if a == heads[c]:
                    values = values.copy()
                    values[0] = 0 if last < 0 else min(self.run[last], self.run[suffixes[0]])
                before = self._before(suffixes)
                self._send(queue, meeting, suffixes, values, before > c, before)
        queue.close()
        return done

    def descending(self, large: Runs, see: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """All suffixes from last to first, given to ``see`` in blocks with the common prefix with the one given before."""
        queue, meeting = Runs(self.symbols, self.memory), Meeting(self.symbols, self.depth)
        for c in range(self.symbols - 1, -1, -1):
            last = -1
            for suffixes, values in queue.drain(c):
                see(suffixes, values)
                before = self._before(suffixes)
                self._send(queue, meeting, suffixes, values, (before <= c) & (before >= 0), before)
                last = int(suffixes[-1])
            following = None
            for suffixes, values in large.drain(c, backwards=True):
                suffixes, shifted = suffixes[::-1], np.empty(len(values), self.value)
                if following is None:
                    following = 0 if last < 0 else min(self.run[last], self.run[suffixes[0]])
                shifted[0], shifted[1:] = following, values[:0:-1]
                following = values[0]
                see(suffixes, shifted)
                before = self._before(suffixes)
                self._send(queue, meeting, suffixes, shifted, (before < c) & (before >= 0), before)
        queue.close()
        large.close()

    # --- star suffixes ---------------------------------------------------------------------------

    def _names(self) -> np.ndarray:
        """A name for each star substring, in text order; equal or larger as the substrings are."""
        stars = self.stars
        by_symbol = stars[np.argsort(self.text[stars], kind="stable")].astype(self.index)
        once = np.ones(len(stars), self.value)
        star = np.zeros(self.n, bool)
        star[stars] = True
        found: list[tuple[np.ndarray, np.ndarray]] = []
        meeting = Meeting(1, self.depth)

        def see(suffixes: np.ndarray, values: np.ndarray) -> None:
            at = np.flatnonzero(star[suffixes])
            _, _, least = meeting.put(values, at, np.zeros(len(at), np.int64))
            found.append((suffixes[at], least))

        self.descending(self.ascending(by_symbol, once), see)
        order, least = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        length = np.zeros(self.n, self.index)
        length[stars] = np.concatenate((np.diff(stars) + 1, [1]))
        a, b = length[order[1:]], length[order[:-1]]
        same = (least[1:] >= np.minimum(a, self.depth)) & ((a == b) | (least[1:] >= self.depth))
        rank = np.concatenate(([0], np.cumsum(~same)))
        name = np.zeros(self.n, np.int64)
        name[order] = rank[-1] - rank + 1  # the order was from last to first
        return name[stars]  # the end of the text is never induced: 0, the least

    def _star_order(self) -> tuple[np.ndarray, np.ndarray]:
        names = self._names()
        m, step, covered = len(names), 1, 2
        while covered < self.depth and names.max() + 1 < m:
            follow = np.zeros(m, np.int64)
            follow[: m - step] = names[step:] + 1
            names = np.unique(names * (m + 2) + follow, return_inverse=True)[1].reshape(-1)
            step, covered = 2 * step, 2 * covered
        order = self.stars[np.argsort(names, kind="stable")].astype(self.index)
        return order, self._common(order)

    def _common(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix with the one before in ``order``, up to ``depth``."""
        out = np.zeros(len(order), self.value)
        width = self.text.itemsize
        per = 8 // width
        padded = np.concatenate((self.text, np.zeros(self.depth + 16, self.text.dtype)))
        words = np.ndarray((len(padded) - per,), "<u8", padded.tobytes(), strides=(width,))
        a, b, at = order[1:].astype(np.int64), order[:-1].astype(np.int64), np.arange(1, len(order))
        for k in range(0, self.depth, per):
            here = (np.minimum(a, b) + k) < self.n
            differ = words[np.minimum(a + k, len(words) - 1)] ^ words[np.minimum(b + k, len(words) - 1)]
            stop = (differ != 0) | ~here
            low = differ[stop] & (~differ[stop] + np.uint64(1))
            first = np.where(low == 0, 0, np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) // (8 * width)
            out[at[stop]] = np.minimum(k + first, self.depth)
            a, b, at = a[~stop], b[~stop], at[~stop]
            if not len(at):
                return out
        out[at] = self.depth
        return out

    # --- results -----------------------------------------------------------------------------------

    def sorted(self, see: Callable[[np.ndarray, np.ndarray], None]) -> None:
        order, common = self._star_order()
        self.descending(self.ascending(order, common), see)

    def repeated(self) -> np.ndarray:
        """Whether the ``depth`` symbols from each position on also start anywhere else."""
        out = np.zeros(self.n, bool)
        last = [-1]

        def see(suffixes: np.ndarray, values: np.ndarray) -> None:
            hit = np.flatnonzero(values >= self.depth)
            out[suffixes[hit]] = True
            earlier = np.where(hit > 0, suffixes[hit - 1], last[0])
            out[earlier] = True
            last[0] = int(suffixes[-1])

        self.sorted(see)
        return out


def repeated_in(contents: list[bytes], depth: int, memory: int = 64 << 20) -> list[np.ndarray]:
    """For each content, whether the ``depth`` bytes from each position on start anywhere else in the contents."""
    sizes = np.array([len(c) for c in contents], np.int64)
    raw = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    kind = np.uint8 if raw.max(initial=0) < 254 else np.uint16
    text = np.concatenate((raw.astype(kind) + kind(2), np.zeros(1, kind)))
    text[ends] = 1
    hit = Sorter(text, depth, memory).repeated()
    starts = ends - sizes
    return [hit[s : s + max(0, n - depth + 1)] for s, n in zip(starts, sizes, strict=True)]
