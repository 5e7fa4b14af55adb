"""Vectorised work on the bytes of Arrow string arrays: words, their hashes and places.

A word is a maximal run of bytes other than ASCII white space. Everything is exact for any
length: the arrays are cut by rows into slices of bounded bytes, and the polynomial prefix sums
that give word hashes are taken over spans of words, so memory follows the slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_SPAN = 1 << 18
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_NOT_WORD = np.ones(256, bool)  # ASCII letters and digits, and all bytes of other characters, make words
_NOT_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        t = np.full(max(n, _SPAN + 1), base, np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        _tables[base] = t
    return t[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its rows in them; a null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = arr.fill_null("")
    _, offs, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64, len(arr) + 1 + arr.offset)[arr.offset :]
    at = int(offsets[0])
    n = int(offsets[-1]) - at
    buf = np.frombuffer(data, np.uint8, n, at) if n else np.zeros(0, np.uint8)
    return buf, offsets - at


def slices(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes, or of one row that is longer."""
    _, offs = raw(arr)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offsets: np.ndarray, punctuation: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry ends the last).

    Without punctuation, a word ends at any ASCII character that is neither a letter nor a digit.
    """
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = ~(_WS if punctuation else _NOT_WORD)[buf]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]  # a row's end ends a word too
    cuts = np.unique(cuts[(cuts > 0) & (cuts < n)])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each [start, end); starts ascend."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        b = buf[lo:hi]
        if lower:
            b = _LOWER[b]
        p = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers(_R, hi - lo), out=p[1:])
        s = starts[i:j] - lo
        out[i:j] = (p[ends[i:j] - lo] - p[s]) * _powers(_RINV, hi - lo + 1)[s]
        i = j
    return mix(out)
