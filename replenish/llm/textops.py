"""Words and rolling hashes over whole batches of texts, in numpy.

Texts of a batch are handled in slices of bounded size, so the arrays of a
task stay small whatever the batch. A word is ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_power = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)

U = np.uint64
#: A random 64-bit value for each byte; ASCII capitals share that of their small letter.
BYTE_VALUE = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finalizer)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _power, _inverse
    if len(_power) < n:
        m = max(n, 2 * len(_power), SLICE_BYTES + 2)
        for name, base in (("_power", _BASE), ("_inverse", _INVERSE)):
            x = np.full(m, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _power, _inverse


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (uint64), equal for equal spans anywhere."""
    p, q = powers(len(values) + 1)
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * p[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * q[start] + (end - start).astype(np.uint64))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets of the rows) with about SLICE_BYTES each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        hi = min(hi, len(column))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words(NamedTuple):
    start: np.ndarray  # byte offsets in the slice
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per row, index of its first word; one more at the end

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, at: np.ndarray, hashed: bool = True) -> Words:
    """Words of each row of a slice; hashes ignore the case of A-Z."""
    n = len(raw)
    body = np.ones(n + 2, bool)
    body[0] = body[-1] = False
    body[1:-1] = (raw != 32) & ((raw - np.uint8(9)) > 4)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = np.flatnonzero(body[1:-1] & (~body[:-2] | cut[:-1]))
    end = np.flatnonzero(body[1:-1] & (~body[2:] | cut[1:])) + 1
    h = span_hashes(BYTE_VALUE[raw], start, end) if hashed else start
    return Words(start, end, h, np.searchsorted(start, at))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs that start at each word, and whether the run stays in its row."""
    n = len(h)
    out = np.zeros(n, np.uint64)
    inside = np.zeros(n, bool)
    m = n - k + 1
    if m <= 0:
        return out, inside
    p, _ = powers(k)
    acc = np.zeros(m, np.uint64)
    for j in range(k):
        acc += h[j : j + m] * p[k - j - 1] if k <= 4 else U(0)
    if k > 4:
        pw, inv = powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(h * pw[:n], out=total[1:])
        acc = (total[k:] - total[: n - k + 1]) * inv[:m]
    out[:m] = mix(acc)
    stop = np.repeat(first[1:], np.diff(first))
    inside[:m] = np.arange(m) + k <= stop[:m]
    return out, inside
