"""A compressed full-text index over words: Burrows-Wheeler transform in a wavelet matrix.

Suffixes are sorted by their first ``depth`` words, which is all that patterns of
up to ``depth`` words need.  The transform is kept as bit planes with sampled
ranks; longest common prefixes, at most ``depth``, take a byte each.
"""

from __future__ import annotations

import numpy as np


class BitPlane:
    """Packed bits with the count of ones before every 64th."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Rank of any symbol in a sequence of small numbers, one bit plane per bit."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.planes: list[BitPlane] = []
        self.bits = max(1, int(size - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(np.uint8)
            self.planes.append(BitPlane(bit))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each symbol occurs before ``lo`` and before ``hi``."""
        start = np.zeros_like(lo)
        for level, plane in zip(range(self.bits - 1, -1, -1), self.planes, strict=True):
            one = (symbol >> level & 1).astype(bool)
            s, a, b = plane.ones(start), plane.ones(lo), plane.ones(hi)
            start = np.where(one, plane.zeros + s, start - s)
            lo = np.where(one, plane.zeros + a, lo - a)
            hi = np.where(one, plane.zeros + b, hi - b)
        return lo - start, hi - start


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Dense rank of every suffix by its first ``depth`` symbols; a shorter one sorts before its extensions."""
    n = len(text)

    def joined(a: np.ndarray, b: np.ndarray, shift: int) -> np.ndarray:
        after = np.zeros(n, np.int64)
        if shift < n:
            after[: n - shift] = b[shift:] + 1
        key = a.astype(np.int64) * (n + 2) + after
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[0, (ranked[1:] != ranked[:-1]).astype(np.int64)]) if n else 0
        return rank

    _, rank = np.unique(text, return_inverse=True)
    by_size = {1: rank.astype(np.int64)}
    size = 1
    while size * 2 <= depth:
        by_size[size * 2] = joined(by_size[size], by_size[size], size)
        size *= 2
    have, rank = size, by_size[size]
    while have < depth:  # the rest from the powers already ranked
        step = max(s for s in by_size if s <= depth - have)
        rank = joined(rank, by_size[step], have)
        have += step
    return rank


class FMIndex:
    """Index of ``text`` (numbers from 0 to ``size`` - 1; 0 separates and matches nothing)."""

    def __init__(self, text: np.ndarray, size: int, depth: int) -> None:
        self.n, self.depth = len(text), depth
        rank = suffix_order(text, depth)
        self.places = np.argsort(rank, kind="stable")
        self.wavelet = WaveletMatrix(text[self.places - 1], size)
        counts = np.bincount(text, minlength=size)
        self.first = np.cumsum(counts) - counts
        lcp = np.zeros(self.n + 1, np.uint8)
        equal = np.ones(max(0, self.n - 1), bool)
        a, b = self.places[:-1], self.places[1:]
        padded = np.concatenate([text, np.full(depth, -1, text.dtype)])
        for k in range(depth):
            equal &= padded[a + k] == padded[b + k]
            equal &= padded[a + k] >= 0
            if not equal.any():
                break
            lcp[1 : self.n] += equal
        self.lcp = lcp
        self._bounds: dict[int, np.ndarray] = {}

    def widened(self, lo: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that share ``depth`` words with the one at each ``lo``."""
        if depth not in self._bounds:
            self._bounds[depth] = np.append(np.flatnonzero(self.lcp[: self.n] < depth), self.n) if depth else np.array([0, self.n])
        bounds = self._bounds[depth]
        at = np.searchsorted(bounds, lo, "right")
        return bounds[at - 1], bounds[at]

    def matching_statistics(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every place of every query: length of the longest match from there (at most
        ``depth`` words), and the interval [lo, hi) of the suffixes that begin with it.

        All queries run right to left in step.  A match is extended by backward search;
        where that fails it is shortened to its parent interval, and tried again.
        """
        order = sorted(range(len(queries)), key=lambda i: -len(queries[i]))
        lengths = np.array([len(queries[i]) for i in order], np.int64)
        total = int(lengths.sum())
        flat = np.concatenate([queries[i] for i in order]) if total else np.empty(0, np.int64)
        last = np.cumsum(lengths) - 1
        out_q, out_lo, out_hi = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, self.n, np.int64)
        lo, hi, q = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for t in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -t, "left"))  # queries longer than t
            place = last[:live] - t
            symbol = flat[place]
            full = np.flatnonzero(q[:live] == self.depth)
            if len(full):
                lo[full], hi[full] = self.widened(lo[full], self.depth - 1)
                q[full] = self.depth - 1
            lost = np.flatnonzero(symbol <= 0)
            lo[lost], hi[lost], q[lost] = 0, self.n, 0
            todo = np.flatnonzero(symbol > 0)
            while len(todo):
                c = symbol[todo]
                a, b = self.wavelet.ranks(c, lo[todo], hi[todo])
                good = b > a
                hit, miss = todo[good], todo[~good]
                lo[hit] = self.first[c[good]] + a[good]
                hi[hit] = self.first[c[good]] + b[good]
                q[hit] += 1
                done = miss[q[miss] == 0]
                lo[done], hi[done] = 0, self.n
                todo = miss[q[miss] > 0]
                if len(todo):  # to the parent: the deepest interval around this one
                    parent = np.maximum(self.lcp[lo[todo]], self.lcp[hi[todo]]).astype(np.int64)
                    for d in np.unique(parent):
                        some = todo[parent == d]
                        lo[some], hi[some] = self.widened(lo[some], int(d))
                        q[some] = d
            out_q[place], out_lo[place], out_hi[place] = q[:live], lo[:live], hi[:live]
        result: list = [None] * len(queries)
        ends = np.cumsum(lengths)
        for k, i in enumerate(order):
            part = slice(int(ends[k] - lengths[k]), int(ends[k]))
            result[i] = (out_q[part], out_lo[part], out_hi[part])
        return result
