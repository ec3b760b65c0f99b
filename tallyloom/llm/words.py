"""Words, hashes and shingles of whole Arrow batches, computed with numpy.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR.
All hashes are 64-bit and depend on the bytes alone, so every task and every
run gives the same value. Work goes slice by slice to keep memory bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy pass holds; a longer text is a slice of its own.
SLICE_BYTES = 512 << 10
#: Powers that are kept for the next slice; longer texts make their own.
KEPT_POWERS = 4 << 20

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]


_kept: dict[int, np.ndarray] = {}


def powers(base: np.uint64, size: int) -> np.ndarray:
    """``base ** 0 .. base ** (size - 1)`` modulo 2**64."""
    known = _kept.get(int(base))
    if known is None or len(known) < size:
        known = np.full(max(1 << 16, 1 << (max(size, 1) - 1).bit_length()), base, np.uint64)
        known[0] = 1
        np.cumprod(known, out=known)
        if len(known) <= KEPT_POWERS:
            _kept[int(base)] = known
    return known[:size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``limit`` bytes together."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), rows)
        yield start, end
        start = end


class Words:
    """The words of consecutive texts: ``row``, ``start``, ``end``, ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        base = offsets[0]
        chars, ends = data[base : offsets[-1]], offsets - base
        self.base, self.rows = base, len(offsets) - 1
        size = len(chars)
        word = ~SPACE[chars]
        edge = np.zeros(size + 1, bool)
        edge[ends] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((BYTE_LOWER if lower else BYTE)[chars] * powers(BASE, size), out=sums[1:])
        value = (sums[self.end] - sums[self.start]) * powers(BASE_INVERSE, size)[self.start]
        length = (self.end - self.start).astype(np.uint64)
        self.hash = mix(value + length * np.uint64(0xA0761D6478BD642F))
        self.row = np.searchsorted(ends, self.start, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hash of every run of ``size`` words inside one text,
        and the position of its first word."""
        n = len(self.hash) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * powers(BASE, len(self.hash)), out=sums[1:])
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        value = (sums[at + size] - sums[at]) * powers(BASE_INVERSE, len(self.hash))[at]
        return mix(value + np.uint64(size)), at

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes of each text and their rows. A text
        of fewer than ``size`` words is one shingle, an empty one none."""
        value, at = self.windows(size)
        row = self.row[at]
        short = np.flatnonzero((self.count > 0) & (self.count < size))
        if len(short):
            begin = np.cumsum(self.count) - self.count
            whole = np.zeros(len(short), np.uint64)
            for k in range(size - 1):
                has = self.count[short] > k
                part = self.hash[np.minimum(begin[short] + k, len(self.hash) - 1)]
                whole += np.where(has, part * powers(BASE, size)[k], np.uint64(0))
            value = np.concatenate([value, mix(whole + self.count[short].astype(np.uint64))])
            row = np.concatenate([row, short])
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        return value[fresh], row[fresh]


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive byte strings of the given lengths as an Arrow column."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lengths),
        [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))],
    )
    return column.cast(pa.binary())
