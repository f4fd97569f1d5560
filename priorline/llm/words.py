"""Words and word shingles of UTF-8 texts as 64-bit hashes, computed over whole Arrow buffers.

A word is a run of bytes outside space, tab, line feed, vertical tab, form feed and carriage return. Its hash is a
polynomial over the bytes, taken from prefix sums, so that no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WIDTH = 5
_BASE = 0x9E3779B97F4A7C15
_CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTES[ord("a") : ord("z") + 1]
_PLACES = mix(np.arange(101, 101 + WIDTH, dtype=np.uint64)) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, _CHUNK_BYTES + 2)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), rows


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about a megabyte; a longer text is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + _CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def hashed(data: np.ndarray, bounds: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a run of rows, and the position of each row's first word in them (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    start, stop = ~space, ~space
    start[1:] &= space[:-1] | edge[1:n]
    stop[:-1] &= space[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    powers, inverse = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * powers[:n], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * inverse[starts]), np.searchsorted(starts, bounds)


def word_runs(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last row, word hashes and row positions for each run of rows of a column."""
    data, offsets = buffers(column)
    for first, last in chunks(offsets):
        bounds = offsets[first : last + 1]
        words, rows = hashed(data[bounds[0] : bounds[-1]], bounds - bounds[0], lower)
        yield first, last, words, rows


def windows(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, in order."""
    total = words[: len(words) - WIDTH + 1] * _PLACES[0]
    for k in range(1, WIDTH):
        total = total + words[k : len(words) - WIDTH + 1 + k] * _PLACES[k]
    return mix(total)


def shingles(words: np.ndarray) -> np.ndarray:
    """Distinct five-word shingles of one text, sorted; of fewer words the whole sequence, of none nothing."""
    n = len(words)
    if not n:
        return words
    if n < WIDTH:
        return mix(np.sum(words * _PLACES[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
    return np.unique(windows(words))


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words; a word and its repeat have one hash in common with all such pairs."""
    found = mix(words[:-1] * _PLACES[0] + words[1:] * _PLACES[1])
    found[words[:-1] == words[1:]] = 1
    return found


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
