"""Numpy helpers for text columns inside Arrow tasks: bytes, words and rolling hashes.

Every helper works on the UTF-8 bytes of many texts laid end to end, with the offset of each text.
Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Texts are taken in pieces of about this many bytes, so that the arrays derived from them
# (some eight bytes a byte each) stay small.  A longer text makes a piece of its own.
PIECE_BYTES = 1 << 19

_rng = np.random.default_rng(20240607)
CODES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASE = 0x9E3779B97F4A7C15 | 1
BASE_2 = 0xC2B2AE3D27D4EB4F | 1


def release() -> None:
    """Give memory back that a task no longer uses: workers stay, idle, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run: Callable) -> Callable:
    """A function of a group that leaves nothing but its result."""

    def group(table):
        result = run(table)
        release()
        return result

    return group


def released_pair(run: Callable) -> Callable:
    """The same for a function of two groups."""

    def pair(left, right):
        result = run(left, right)
        release()
        return result

    return pair


def released_batches(run: Callable) -> Callable:
    """The same for a function of an iterator of batches."""

    def batches(source):
        yield from run(source)
        release()

    return batches


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``size`` bytes: first row, last row + 1, bytes, offsets."""
    data, at = texts(column)
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + size, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``; words do not cross rows."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~_SPACE[data]
    before, after = solid[:-2].copy(), solid[2:].copy()
    filled = at[:-1][at[1:] > at[:-1]]
    before[filled] = False
    if len(data):
        after[filled[1:] - 1] = False
        after[-1] = False
    inner = solid[1:-1]
    starts = np.flatnonzero(inner & ~before)
    ends = np.flatnonzero(inner & ~after) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


class _Tables(dict):
    """Powers by base; rebuilt where needed, never sent along with a function."""

    def __reduce__(self):
        return _Tables, ()


class Rolling:
    """Hashes of any byte range in constant time, from one pass over the bytes.

    The hash of ``data[s:e]`` is a polynomial modulo 2**64 over random odd codes of the bytes,
    mixed at the end, so that it depends on the bytes only and not on where they lie.
    """

    _powers = _Tables()

    def __init__(self, data: np.ndarray, base: int = BASE):
        power, self.inverse = self._table(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(CODES[data] * power[: len(data)], out=self.sums[1:])

    @classmethod
    def _table(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        held = cls._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, PIECE_BYTES + 1)
            grown = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, np.uint64(b))
                steps[0] = 1
                grown.append(np.cumprod(steps, dtype=np.uint64))
            held = (grown[0], grown[1])
            if size <= 16 * PIECE_BYTES:
                cls._powers[base] = held
        return held

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def windows(self, size: int) -> np.ndarray:
        """A hash of every ``size`` bytes, good in its high bits."""
        return (self.sums[size:] - self.sums[:-size]) * self.inverse[: len(self.sums) - size] * np.uint64(BASE_2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Order-dependent hash of aligned hash arrays."""
    total = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        total = (total * np.uint64(BASE)) + part
    return mix(total)


def long_type(column: np.ndarray) -> np.ndarray:
    return column.view(np.int64)
