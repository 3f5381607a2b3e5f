"""Whole Arrow batches of texts as arrays of symbols (bytes or words) and
hashes of all their substrings of one length, without a loop over characters.

Hashes are polynomials modulo 2**64 over scrambled symbols, finished by a
mixing step. With prefix sums S, the substring [i, j) hashes to
(S[j] - S[i]) * BASE**-i.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
SEGMENT = 1 << 20
BLANKS = np.zeros(256, bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * BASE)
_TABLES: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base)
        p[0] = 1
        have = _TABLES[int(base)] = np.multiply.accumulate(p)
    return have[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=s[1:])
    return s


def span_hash(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mixed((s[hi] - s[lo]) * powers(INVERSE, len(s))[lo])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, and the rows' offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def stretches(ends: np.ndarray, size: int | None = None):
    """Ranges of rows (first, last + 1) of about ``size`` bytes."""
    at, size = 0, size or 2 * SEGMENT
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, to
        at = to


def byte_values(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes themselves (their 64-bit values, ``BYTE``, are looked up
    part by part)."""
    return data, offsets


def word_values(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each word of each row, and the rows' offsets in
    words. ``fold`` lower-cases A-Z first."""
    blank = BLANKS[data]
    inner = np.zeros(len(data) + 1, bool)
    inner[offsets[(offsets > 0) & (offsets < len(data))]] = True  # a row ends: so does its word
    start = ~blank
    start[1:] &= blank[:-1] | inner[1:-1]
    starts = np.flatnonzero(start)
    stop = np.append(blank[1:], True) | inner[1:]
    if len(data):
        stop[-1] = True
    ends = np.flatnonzero(~blank & stop) + 1
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # prefix sums over bounded stretches of bytes
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))
        lo = starts[at]
        piece = data[lo:ends[to - 1]]
        s = prefix_sums(BYTE[FOLD[piece] if fold else piece])
        b, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = span_hash(s, b, e) ^ (e - b).astype(np.uint64)
        at = to
    return mixed(out), np.searchsorted(starts, offsets)


def pieces(offsets: np.ndarray, margin: int, size: int = SEGMENT):
    """Groups of rows of about ``size`` symbols. Yields lists of
    (row, lo, hi, own_lo, own_hi): a row longer than ``size`` comes in parts
    that own disjoint ranges and reach ``margin`` symbols beyond them."""
    group, total = [], 0
    for r in range(len(offsets) - 1):
        lo, hi = int(offsets[r]), int(offsets[r + 1])
        for own in range(lo, max(hi, lo + 1), size):
            end = min(own + size, hi)
            group.append((r, max(lo, own - margin), min(hi, end + margin), own, end))
            total += end - own
            if total >= size:
                yield group
                group, total = [], 0
    if group:
        yield group
