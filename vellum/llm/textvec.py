"""Words and word n-grams of many texts at a time, as hashes in numpy arrays.

Hashes of 64 bits find candidates; what decides that two texts are the same has two of them, 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import ship

ship(__name__)

#: Bytes of text worked on at a time, unless one text is longer.
CHUNK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def constants(n: int, stream: int) -> np.ndarray:
    """n odd pseudo-random numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(stream)) | np.uint64(1)


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z; UTF-8 bytes above 0x7F belong to words in both.
SPACED = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)


class Texts:
    """A string column of an Arrow batch as bytes; null is empty."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.binary()).fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        self.data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        self.offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)

    def chunks(self, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, row after the last, bytes, offsets) of runs of rows."""
        lo, n = 0, len(self.offsets) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(self.offsets, self.offsets[lo] + limit, "right")) - 1)
            hi = min(hi, n)
            a, b = self.offsets[lo], self.offsets[hi]
            yield lo, hi, self.data[a:b], self.offsets[lo : hi + 1] - a
            lo = hi


class Words:
    """The words of some texts: starts and ends in bytes, hashes, and each text's first word in `bounds`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, part: np.ndarray = SPACED, fold: np.ndarray = SAME):
        n = len(data)
        inside = part[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        self._folded = fold[data[inside]]
        self.hashes = self._hash(self._folded, 0)

    def _hash(self, folded: np.ndarray, lane: int) -> np.ndarray:
        """A 64-bit hash of each word: its blocks of 8 bytes are mixed one by one before they are added up, each with numbers of its own place.

        Words of up to 8 bytes and equal length surely differ in their hashes if they differ.
        """
        lengths = self.ends - self.starts
        blocks = (lengths + 7) >> 3
        first = np.cumsum(blocks) - blocks
        padded = np.zeros(int(blocks.sum()) * 8, np.uint8)
        begin = np.cumsum(lengths) - lengths
        padded[np.arange(len(folded)) + np.repeat(first * 8 - begin, lengths)] = folded
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        longest = int(blocks.max())
        mixed = mix(padded.view("<u8") + fixed(longest, 21 + lane)[place]) * fixed(longest, 31 + lane)[place]
        return mix(np.add.reduceat(mixed, first) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def second(self) -> np.ndarray:
        """Hashes of the words that do not depend on the first ones, so both together are 128 bits."""
        return self._hash(self._folded, 1) if len(self.starts) else self.hashes

    def grams(self, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words, text by text, and where each text's begin (one entry more than texts).

        A text of fewer words, but not none, is one gram as a whole.  `hashes` are those of the words, the first ones if not given.
        """
        counts = np.diff(self.bounds)
        h, factor = self.hashes if hashes is None else hashes, constants(k, 11)
        if len(h) >= k:
            total = np.zeros(len(h) - k + 1, np.uint64)
            for j in range(k):
                total += h[j : len(h) - k + 1 + j] * factor[j]
            total = mix(total)
        else:
            total = np.zeros(0, np.uint64)
        short = (counts > 0) & (counts < k)
        n = np.maximum(counts - k + 1, 0) + short
        bounds = np.concatenate([[0], np.cumsum(n)])
        index = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], n)
        out = np.zeros(bounds[-1], np.uint64)
        ok = np.repeat(~short, n)
        out[ok] = total[index[ok]]
        for i in np.flatnonzero(short):
            own = h[self.bounds[i] : self.bounds[i + 1]]
            out[bounds[i]] = mix(np.array([(own * factor[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))]))[0]
        return out, bounds


_fixed: dict[int, np.ndarray] = {}


def fixed(n: int, stream: int) -> np.ndarray:
    """At least n constants(), kept for the next call."""
    if len(_fixed.get(stream, ())) < n:
        _fixed[stream] = constants(max(n, 256), stream * 0x1000003)
    return _fixed[stream]


def wide(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Two arrays of 64-bit numbers as one of 16 bytes each."""
    return np.stack([first.view(np.uint64), second.view(np.uint64)], axis=1).astype("<u8").view("V16").ravel()


def wide_array(ids: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ids).tobytes())]).cast(pa.binary())


def distinct_in_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their bounds."""
    v = values.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        v[lo:hi].sort()
    r = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    n = np.bincount(r[keep], minlength=len(bounds) - 1)
    return v[keep], np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
