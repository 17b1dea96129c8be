"""Words of whole Arrow batches at a time: their places, hashes that route them, digests that identify runs of them."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of an array of texts: runs of bytes outside white space, NULL texts have none.

    ``data`` holds all words, each followed by one space; word i lies at ``starts[i]`` up to
    ``starts[i + 1] - 1``; ``counts`` is the number of words of every text.
    """

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.fill_null("").cast(pa.large_string())
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
        ends = at - at[0]
        # A word ends with its text: a space goes between texts.
        raw = np.insert(raw, ends[1:], 0x20)
        ends = ends + np.arange(len(ends))
        space = _SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        kept = ~space
        kept[1:] |= ~space[:-1]  # of the spaces after a word the first stays
        place = np.cumsum(kept) - 1
        data = raw[kept]
        data[space[kept]] = 0x20
        starts = np.flatnonzero(first)
        self.counts = np.diff(np.searchsorted(starts, ends))
        self.data, self.starts = data, np.append(place[starts], len(data))

    def hashes(self) -> np.ndarray:
        """A hash of every word; different words may share one, so it only routes."""
        if len(self.starts) < 2:
            return np.empty(0, np.uint64)
        inside = np.arange(len(self.data)) - np.repeat(self.starts[:-1], np.diff(self.starts))
        # Every byte at every place has a scrambled value of its own; they add up.
        return mix(np.add.reduceat(mix(inside.astype(np.uint64) * np.uint64(256) + self.data), self.starts[:-1]))

    def digests(self, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
        """16 bytes of the sha256 of the words ``begin`` up to ``begin + size``: equal for equal word sequences only."""
        view, sha = memoryview(self.data.tobytes()), hashlib.sha256
        places = zip(self.starts[begin].tolist(), (self.starts[begin + size] - 1).tolist(), strict=True)
        return [sha(view[a:z]).digest()[:16] for a, z in places]


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on (fewer at the end give fewer results)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(length):
        total = mix(total + hashes[i : i + n] + _GOLDEN)
    return total


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of the ``width`` values from each place on."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out
