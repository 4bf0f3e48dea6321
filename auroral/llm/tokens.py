"""Vectorised tokenisation of Arrow string columns.

A batch is cut into chunks of about ``CHUNK_BYTES`` of UTF-8, each a flat byte
array with document offsets. Tokens are runs of one byte class; their 64-bit
hashes come from one prefix sum over the chunk, so that no Python loop runs
over words or characters. A document longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * _MIX1
    h = h ^ (h >> np.uint64(27))
    h = h * _MIX2
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, base, np.uint64)])) for base in (_MULTIPLIER, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each span; values are uint64."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values (empty if there are fewer)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return span_hashes(hashes, starts, starts + size)


def classes(*runs: tuple[int, int, int], default: int = 0) -> np.ndarray:
    """A class for each byte value from (first, last, class) runs."""
    table = np.full(256, default, np.uint8)
    for first, last, kind in runs:
        table[first : last + 1] = kind
    return table


#: Words are what stands between ASCII white space.
WHITESPACE = classes((0x09, 0x0D, 0), (0x20, 0x20, 0), default=1)
#: Letters, digits and all non-ASCII bytes are words (1), other visible bytes are runs of signs (2).
SIGNS = classes((0x09, 0x0D, 0), (0x20, 0x20, 0), (0x30, 0x39, 1), (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1), default=2)
#: Digits, a-z and all non-ASCII bytes; A-Z too, as LOWER is applied first.
WORDS = classes((0x30, 0x39, 1), (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0x80, 0xFF, 1))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch as bytes; offsets has a place more than there are rows."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def tokens(self, table: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (bytes), hashes and the row (from 0) of each token: maximal runs of one non-zero class within a row."""
        data = LOWER[self.data] if lower else self.data
        kind = table[data]
        cut = np.empty(len(kind) + 1, bool)
        cut[0] = cut[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
        cut[self.offsets] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[keep], ends[keep]
        rows = np.searchsorted(self.offsets, starts, side="right") - 1
        return starts, ends, span_hashes(_byte_values()[data], starts, ends), rows


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _trim() -> None:
    """Give freed memory back to the system: a worker lives on for other tasks, and its heap would keep the largest size it ever had."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, offsets = flat(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
    if len(data) > limit:
        _trim()


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n)
