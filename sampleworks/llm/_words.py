"""Word and shingle hashes of many texts at once, by array operations on their bytes.

The hash of a word is a polynomial in its bytes modulo 2**64, taken as a difference of prefix sums and passed
through a mixing function; a shingle's hash mixes those of its words. No loop runs over words or bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)
BLOCK_BYTES = 1 << 19
#: what stands between words: space, tab, line feed, vertical tab, form feed, carriage return
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = np.random.RandomState(20_240_601).randint(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
WEIGHTS = [np.uint64(w) for w in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and where each text begins; null texts are empty."""
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], np.int64 if column.type == pa.large_string() else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words before each text (one entry more than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~separators[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    begins = inside & (first[:-1] | np.concatenate(([True], ~inside[:-1])))
    ends = inside & (first[1:] | np.concatenate((~inside[1:], [True])))
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers_to(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(VALUES[fold[data]] * power[:n], dtype=np.uint64)))
    hashes = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct runs of ``size`` words, sorted; a shorter text is one run; without words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        total = total + mix(words[i : n - width + 1 + i] * WEIGHTS[i % len(WEIGHTS)] + np.uint64(i))
    return np.unique(mix(total))
