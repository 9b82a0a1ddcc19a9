"""Words, shingles and hashes of whole Arrow batches, in numpy.

Everything works on the UTF-8 bytes of a column: lower-casing touches A-Z only and words are
runs of bytes other than space and 0x09-0x0D, so no character is ever decoded.  A 64-bit hash
stands for a word or a shingle.  Batches are cut into pieces of about a megabyte, so the
temporaries of a task stay at a few tens of megabytes however long its batches are; a single
longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
PIECE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_random = np.random.default_rng(20240501)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers = {1: np.ones(1, np.uint64), -1: np.ones(1, np.uint64)}


def _power(n: int, sign: int) -> np.ndarray:
    """The powers 0 to n of the base (or of its inverse) modulo 2**64."""
    if len(_powers[sign]) <= n:
        steps = np.full(max(n + 1, 1 << 16), _BASE if sign > 0 else pow(_BASE, -1, 1 << 64), np.uint64)
        steps[0] = 1
        _powers[sign] = np.cumprod(steps)
    return _powers[sign]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero, and the bytes, of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high


class Words(NamedTuple):
    """The words of some texts: row, byte range, 64-bit hash; ``data`` is lower-cased."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges of ``data``, any number of them in a few passes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(n, 1)[:n], out=total[1:])
    value = (total[end] - total[start]) * _power(n, -1)[start]
    return mix(value + (end - start).astype(np.uint64) * _PLACE[0])


def words(offsets: np.ndarray, data: np.ndarray, lower: bool = True) -> Words:
    """All words of the texts that ``offsets`` cuts ``data`` into."""
    data = _LOWER[data] if lower else data
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, none.astype(np.uint64))
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside & edge[:-1], inside & edge[1:]
    first[1:] |= inside[1:] & ~inside[:-1]
    last[:-1] |= inside[:-1] & ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, row, start, end, hashes(data, start, end))


def grams(value: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of every run of ``size`` words that stays inside one row."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += value[k:k + n] * _PLACE[k]
    at = np.flatnonzero(row[:n] == row[size - 1:])
    return at, mix(total[at])


def shingle_sets(found: Words, rows: int, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingles of each row: bounds (one more than rows) and hashes.

    A row of fewer words than ``size`` has its whole sequence as one shingle; a row without
    words has none.
    """
    at, value = grams(found.hash, found.row, size)
    row = found.row[at]
    count = np.bincount(found.row, minlength=rows)
    if (short := np.flatnonzero((count > 0) & (count < size))).size:
        first = np.searchsorted(found.row, short)
        extra = np.array([int(mix(np.sum(found.hash[f:f + c] * _PLACE[8:8 + c], keepdims=True) + np.uint64(c))[0])
                          for f, c in zip(first, count[short])], np.uint64)
        row, value = np.concatenate([row, short]), np.concatenate([value, extra])
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    for low, high in zip(bounds[:-1], bounds[1:]):
        value[low:high].sort()
    if len(value):
        fresh = np.ones(len(value), bool)
        fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[fresh], row[fresh]
    return np.searchsorted(row, np.arange(rows + 1)), value


def long(value: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as the signed column Spark has for them."""
    return pa.array(value.view(np.int64))
