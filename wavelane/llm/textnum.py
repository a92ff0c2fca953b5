"""Numpy kernels over Arrow text columns: byte views, words, hashes.

A text column is handled as one byte array with row offsets, so that hashing,
word finding and shingling run over a few megabytes at a time without a Python
object per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once by the numpy kernels.
SLICE_BYTES = 1 << 19

# The six ASCII white-space characters that separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: The weight of each byte in a hash, and of each byte with A-Z folded.
BYTE_KEYS = np.arange(1, 257, dtype=np.uint64)
FOLDED_KEYS = BYTE_KEYS.copy()
FOLDED_KEYS[65:91] = BYTE_KEYS[97:123]
# Hashes are polynomials modulo a prime; modulo 2^64 they would collide on strings of a regular make, whatever the base.
_PRIME = U64(2**61 - 1)
_BASE = U64(0x0E3779B97F4A7C15)
_LOW32, _LOW31, _LOW30, _LOW29 = (U64(2**k - 1) for k in (32, 31, 30, 29))
#: Bytes whose unreduced sums fit 64 bits.
_MOST_UNREDUCED = 1 << 22


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> U64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def multiplied(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b modulo 2^61 - 1, of numbers below it."""
    a1, a0, b1, b0 = a >> U64(31), a & _LOW31, b >> U64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(U64(2) * a1 * b1 + (middle >> U64(30)) + ((middle & _LOW30) << U64(31)) + a0 * b0)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U64)
    while len(out) < n:
        out = np.concatenate([out, multiplied(out, np.full(len(out), pow(base, len(out), int(_PRIME)), U64))])
    return out[:n]


_tables = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _tables["n"] < n:
        size = max(n, SLICE_BYTES + 1)
        up = _powers(int(_BASE), size)
        _tables.update(n=size, up=up, halves=(up & _LOW32, up >> U64(32)), down=_powers(pow(int(_BASE), -1, int(_PRIME)), size))
    return _tables["up"], _tables["down"]


class Sums:
    """Running sums of numbers below 2^61 - 1 times the powers of a base, from which any span's polynomial follows."""

    def __init__(self, values: np.ndarray, small: bool = False):
        """``small``: all values are 256 at most."""
        up, self.down = _power_tables(len(values) + 1)
        if small and len(values) <= _MOST_UNREDUCED:
            low, high = (values * half[: len(values)] for half in _tables["halves"])
        else:
            term = multiplied(values, up[: len(values)])
            low, high = term & _LOW32, term >> U64(32)
        self.low, self.high = np.zeros(len(values) + 1, U64), np.zeros(len(values) + 1, U64)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The polynomials of spans, each as if it began at 0."""
        high = self.high[ends] - self.high[starts]
        value = _reduced(_reduced(self.low[ends] - self.low[starts]) + (high >> U64(29)) + ((high & _LOW29) << U64(32)))
        return multiplied(value, self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def returned(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, and afterwards memory that is free in its process goes back to the machine.

    Spark's Python processes outlive their tasks. What one step has had and freed would stay with them, as the allocators keep
    it, and add to what the next step needs.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return own


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its n + 1 row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def row_ranges(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer row is a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


def find_words(data: np.ndarray, offsets: np.ndarray, separates: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each row, and the rows' n + 1 word offsets."""
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~separates[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes, and two that differ one alike with a chance of
    their length in 2^61 at most for a base drawn at random."""
    return mix(Sums(keys[data], small=True).of(starts, ends) + (ends - starts).astype(U64))


def shingles(words: np.ndarray, word_offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of ``size`` words, and the rows' n + 1 offsets.

    A row with fewer words, but any, has its whole sequence as one shingle.
    """
    n = np.diff(word_offsets)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    total = int(out_at[-1])
    if total == 0:
        return np.zeros(0, U64), out_at
    row = np.repeat(np.arange(len(n)), counts)
    first = word_offsets[:-1][row] + np.arange(total) - out_at[:-1][row]
    length = np.minimum(n, size)[row]
    padded = np.concatenate([words, np.zeros(size, U64)])
    value = length.astype(U64)
    for k in range(size):
        step = mix(value * U64(0xD6E8FEB86659FD93) + padded[first + k])
        value = np.where(k < length, step, value) if k else step
    return value, out_at


def distinct_by_row(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in rising order, and the rows' n + 1 offsets."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(n + 1))


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of each row's values; 0 for a row without values."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
