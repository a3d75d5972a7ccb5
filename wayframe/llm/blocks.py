"""Work on whole texts as byte arrays, a bounded piece of an Arrow batch at a time.

A text column of an Arrow batch is one run of UTF-8 bytes with offsets.  The helpers here
look at such runs with numpy, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are looked at together; one longer text is a piece by itself.
PIECE = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = max(n, PIECE + (PIECE >> 2))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pieces(column: pa.Array, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of consecutive rows; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Kinds of bytes: 0 white space, 1 letters, digits and bytes of longer characters, 2 the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1
_SOLID = (_KIND > 0).astype(np.uint8)


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def tokens(data: np.ndarray, offsets: np.ndarray, runs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each token; none crosses texts.

    With ``runs`` a token is a run of bytes of one kind (words apart from their marks), else
    a run without white space.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = (_KIND if runs else _SOLID)[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(edge)
    ends = np.append(at[1:], len(data))
    solid = kind[at] > 0
    start, end = at[solid], ends[solid]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, final: bool = True) -> np.ndarray:
    """A 64-bit hash of each token's bytes, the same wherever the token stands; its low bits are good only after ``mixed``."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mixed(h) if final else h
