"""Words of whole texts as byte positions, found for many texts at once with numpy.

A text is read as UTF-8. Both word rules of this package separate on ASCII bytes only, so a
byte belongs to a word or not whatever stands around it, and no text is ever decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Text bytes looked at together; a longer text is a block of its own.
BLOCK = 1 << 20

_BYTES = np.arange(256)
#: a-z for A-Z, every other byte as it is
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: `[^\x20\x09-\x0D]`
SOLID = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, in lower-cased text
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIXED = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept while no longer run is asked for."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, BLOCK + 1), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text starts and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    text = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return text[at[0]:at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows holding about `limit` bytes."""
    data, at = column_bytes(column)
    lo, rows = 0, len(at) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def word_bounds(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text."""
    inside = table[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    start[at[:-1][full]] = inside[at[:-1][full]]
    end[at[1:][full] - 1] = inside[at[1:][full] - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIXED[data] * powers(_BASE, len(data)), out=running[1:])
    found = (running[ends] - running[starts]) * powers(_INVERSE, len(data))[starts]
    found += _MIXED[(ends - starts) & 255]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbouring words, in order."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    n = len(hashes) - width + 1
    found = np.zeros(n, np.uint64)
    for k, step in enumerate(powers(0xD6E8FEB86659FD93, width)):
        found += hashes[k:k + n] * step
    found ^= found >> np.uint64(32)
    return found * np.uint64(0x94D049BB133111EB)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `values` between neighbouring entries of `first`."""
    running = np.zeros(len(values) + 1, np.result_type(values.dtype, np.int64))
    np.cumsum(values, out=running[1:])
    return running[first[1:]] - running[first[:-1]]
