"""Vectorised text kernels: an Arrow string array becomes word, line and shingle hashes without a Python object a word.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit: a random value for each byte, weighted
by powers of an odd number (so that any run's hash comes from one cumulative sum), then mixed. Work goes in slices of
about SLICE bytes, so memory follows the longest single text and not the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
BATCH, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
U = np.uint64
_RNG = np.random.Generator(np.random.Philox(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_P = U(0x9E3779B97F4A7C15)
_P_INV = U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_TAPS = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow = [np.ones(1, U), np.ones(1, U)]


def released(function):
    """A partition function that hands freed memory back to the system after every batch: Python workers live on."""

    @functools.wraps(function)
    def part(batches):
        for out in function(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
            _trim()
        _trim()

    return part


def map_batches(df, function, schema: str):
    """df.mapInArrow with small batches: where the session leaves Spark's default, a batch is BATCH bytes, because each
    running task holds several, on both sides of the pipe and outside the heap."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) in ("67108864b", "64MB", "64m"):
        conf.set(_BATCH_KEY, BATCH)
    return df.mapInArrow(released(function), schema)


def _trim() -> None:
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        for i, base in enumerate((_P, _P_INV)):
            x = np.full(max(n, SLICE), base, U)
            x[0] = 1
            _pow[i] = np.cumprod(x, dtype=U)
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * _TAPS[0]
    x = (x ^ (x >> U(27))) * _TAPS[1]
    return x ^ (x >> U(31))


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE bytes; null counts as empty."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None and arr.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(stop: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes that are no stops; runs don't cross rows."""
    n = len(stop)
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = True
    on = ~stop
    before = np.concatenate(([True], stop[:-1])) | edge[:n]
    after = np.concatenate((stop[1:], [True])) | np.concatenate((edge[1:n], [True]))
    start, end = np.flatnonzero(on & before), np.flatnonzero(on & after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], dtype=U, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


class Words:
    """The words of a slice: start, end, row, place in the row, and words of each row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.start, self.end, self.row = runs(_SPACE[data], off)
        self.count = np.bincount(self.row, minlength=len(off) - 1)
        self.first = np.concatenate(([0], np.cumsum(self.count)))
        self.hash = hashes(self.data, self.start, self.end)
        self.place = np.arange(len(self.row)) - self.first[self.row]

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every window of k words, or of the whole sequence where a row has fewer."""
        left = self.count[self.row] - self.place
        at = np.flatnonzero((left >= k) | (self.place == 0))
        padded = np.concatenate((self.hash, np.zeros(k, U)))
        total, left = np.zeros(len(at), U), left[at]
        for i in range(k):
            total += np.where(i < left, padded[at + i], U(0)) * (_TAPS[i % 5] + U(2 * (i // 5)))
        return self.row[at], mix(total)
