"""Words, word hashes and shingles of whole texts, one numpy pass per Arrow batch.

A word is a run of bytes other than space and 0x09..0x0D; A-Z count as a-z.  Hashes are 64 bits wide and depend on
the word alone, so they agree between tasks and runs.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

WINDOW_BYTES = 2 << 20
HASHED_BYTES = 1 << 18  # bytes whose hashes are taken together, so that they stay in the cache

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


Batches = Iterator[pa.RecordBatch]
RELEASE_SECONDS = 1.0

# What the tasks of one Python worker keep for later ones.  Workers outlive their tasks, so it has to go when others run.
MEMORY: dict[str, dict] = {}


def _release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Batches], Batches], keep: str | None = None) -> Callable[[Batches], Batches]:
    """A task that first drops what other kinds of tasks keep in this worker, and leaves no freed memory behind."""

    @wraps(run)
    def bounded(batches: Batches) -> Batches:
        for name in MEMORY.keys() - {keep}:
            del MEMORY[name]
        _release()
        last = time.monotonic()
        for out in run(batches):
            yield out
            if time.monotonic() - last > RELEASE_SECONDS:
                _release()
                last = time.monotonic()
        _release()

    return bounded


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> _U(30)
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _rising(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(max(1024, 1 << int(n - 1).bit_length()), base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers 0..n-1 of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        _powers = _rising(_BASE | _U(1), n)
    return _powers[:n]


def _inverse(n: int) -> np.ndarray:
    """The inverses of ``powers``."""
    global _inverses
    if len(_inverses) < n:
        _inverses = _rising(_U(pow(int(_BASE) | 1, -1, 1 << 64)), n)
    return _inverses[:n]


class Words:
    """The words of a run of documents.

    ``text``: the joined bytes in lower case; ``start``/``end``: byte range of each word; ``first``: index of the first
    word of each document, with the total as its last entry; ``bounds``: the same for bytes.
    """

    def __init__(self, raw: np.ndarray, bounds: np.ndarray):
        self.text = _LOWER[raw]
        self.bounds = bounds
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = ~_SPACE[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[bounds[:-1]] |= inside[bounds[:-1]]
        self.start = np.flatnonzero(begins)
        stops = ~inside
        stops[1:] &= inside[:-1]
        stops[0] = False
        at = bounds[1:][inside[bounds[1:]] & (bounds[1:] > 0) & inside[np.maximum(bounds[1:] - 1, 0)]]
        stops[at] = True
        stops[-1] = len(raw) > 0 and inside[-2]
        self.end = np.flatnonzero(stops)
        self.first = np.searchsorted(self.start, bounds)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A word's hash is the sum of its bytes' values times powers by place: a difference of two running sums."""
        out = np.empty(len(self.start), dtype=np.uint64)
        lo = 0
        while lo < len(out):
            at = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, at + HASHED_BYTES, side="right")))
            begin, end = self.start[lo:hi] - at, self.end[lo:hi] - at
            sums = np.zeros(int(end[-1]) + 1, dtype=np.uint64)
            np.cumsum(_BYTES[self.text[at:at + end[-1]]] * powers(int(end[-1])), out=sums[1:])
            out[lo:hi] = (sums[end] - sums[begin]) * _inverse(int(begin[-1]) + 1)[begin]
            lo = hi
        return mix(out)

    def word(self, i: int) -> bytes:
        return self.text[self.start[i]:self.end[i]].tobytes()

    def shingles(self, k: int = 5, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word shingles in order and the bounds per document.

        A document of fewer words has its whole sequence as its one shingle, one without words has none.
        """
        h = self.hashes() if hashes is None else hashes
        counts = self.counts
        n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
        bounds = np.concatenate([[0], np.cumsum(n)])
        if not bounds[-1]:
            return np.zeros(0, dtype=np.uint64), bounds
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(bounds[-1]) - bounds[owner] + self.first[owner]
        width = np.minimum(counts, k)[owner]
        padded = np.concatenate([h, np.zeros(k, dtype=np.uint64)])
        out = np.zeros(bounds[-1], dtype=np.uint64)
        weights = powers(k + 1)
        for j in range(k):
            out += np.where(j < width, padded[at + j], _U(0)) * weights[j + 1]
        return mix(out + width.astype(np.uint64)), bounds


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def windows(column: pa.Array, limit: int = WINDOW_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text is a range of its own)."""
    _, bounds = raw_texts(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def word_runs(column: pa.Array, limit: int = WINDOW_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi in windows(column, limit):
        yield lo, hi, Words(*raw_texts(column.slice(lo, hi - lo)))
