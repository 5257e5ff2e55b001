"""Vectorised word and word-gram hashes over the UTF-8 bytes of an Arrow text column.

A word's hash is a polynomial over per-byte random values, taken from one running sum, so
the cost is a few array operations per byte and none per word. A-Z count as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SLICE = 1 << 19
_powers: dict[str, np.ndarray] = {}

_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(
    1, np.iinfo(np.uint64).max, size=256, dtype=np.uint64
)
_VALUES[65:91] = _VALUES[97:123]
_COEFFICIENTS = np.random.Generator(np.random.PCG64(77)).integers(
    1, np.iinfo(np.uint64).max, size=64, dtype=np.uint64
) | np.uint64(1)

#: Words of every byte but the six white-space ones.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of digits, letters and all bytes beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z as a-z, for bytes.translate.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(str(base))
    if held is None or len(held) < n:
        held = np.full(max(n, _SLICE + 1), base, dtype=np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        _powers[str(base)] = held
    return held[:n]


@dataclass
class Words:
    """Words of a column: hash, byte range within ``data`` and row of each."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # index of each row's first word; one more at the end
    data: np.ndarray
    offsets: np.ndarray  # byte offsets of the rows in data

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    if buffers[1] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=kind)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    if buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, is_word: np.ndarray) -> Words:
    data, offsets = text_bytes(column)
    n = len(data)
    inside = is_word[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets < n)]
        begins[edge] = inside[edge]
        edge = offsets[(offsets > 0)] - 1
        ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):  # slices of whole words, so a long text needs no wide arrays
        to = max(at + 1, int(np.searchsorted(end, start[at] + _SLICE, "right")))
        low, high = int(start[at]), int(end[to - 1])
        part = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(
            _VALUES[data[low:high]] * _power(_BASE, high - low), out=part[1:], dtype=np.uint64
        )
        hashes[at:to] = (part[end[at:to] - low] - part[start[at:to] - low]) * _power(
            _INVERSE, high - low
        )[start[at:to] - low]
        at = to
    row = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(row, np.arange(len(offsets)))
    return Words(mix(hashes), start, end, row, first, data, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; entry i covers words i to i+k-1, rows not regarded."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _COEFFICIENTS[j]
    return mix(total)


def winnowed(g: np.ndarray, valid: np.ndarray, window: int) -> np.ndarray:
    """Positions of k-grams that are least in some window of valid neighbours."""
    n = len(g) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, whole = g[:n].copy(), valid[:n].copy()
    for j in range(1, window):
        np.minimum(least, g[j : j + n], out=least)
        whole &= valid[j : j + n]
    chosen = np.zeros(len(g), bool)
    for j in range(window):
        chosen[j : j + n] |= whole & (g[j : j + n] == least)
    return np.flatnonzero(chosen)
