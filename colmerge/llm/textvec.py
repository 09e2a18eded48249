"""Vectorised words and word n-grams over Arrow string columns.

Spark partitions and ships the rows; these helpers work on one bounded slice of an Arrow batch at a time, on the
column's own UTF-8 buffer, so no Python object is made for a word. Words are ``[^\\x20\\x09-\\x0D]+``.

Hashes are 64-bit: a word is taken in steps of 8 bytes, each mixed into the hash so far (long words by BLAKE2b), and an n-gram is a
polynomial over its word hashes, mixed again. They depend on the content alone, so every task, run and machine agrees on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the word polynomial, and its inverse modulo 2**64.
WORD_P = 0xD6E8FEB86659FD93
WORD_INV = pow(WORD_P, -1, 1 << 64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Text bytes that one slice holds at most, unless a single document is longer.
SLICE_BYTES = 1 << 20

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 2 * SLICE_BYTES:
            _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser; other salts give other, independent-looking values."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large UTF-8, nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in those bytes) for runs of rows of about ``limit`` bytes."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def separators(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


class Words:
    """The words of a slice: ``start``/``end`` bytes of each, and ``first`` word of each row (one entry more)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~separators(data)
        step = np.diff(inside)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cuts = offsets[1:-1]
        if len(cuts) and len(start):  # a word that runs over the border of two rows is one word in each
            k = np.searchsorted(start, cuts, side="right") - 1
            cut = np.unique(cuts[(k >= 0) & (start[np.maximum(k, 0)] < cuts) & (end[np.maximum(k, 0)] > cuts)])
            if len(cut):
                start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        self.data, self.start, self.end = data, start, end
        self.first = np.searchsorted(start, offsets, side="left")
        self.first[-1] = len(start)

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit hash of each word's bytes."""
        size = self.end - self.start
        value = mix(size.astype(np.uint64), 1)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        # the 8 bytes from each place on; those behind a word's end are masked
        eight = np.lib.stride_tricks.as_strided(padded, (len(self.data) + 1, 8), (1, 1))
        at, step = np.flatnonzero(size <= LONG_WORD), 0
        while len(at):
            left = np.minimum(size[at] - step, 8).astype(np.uint64)
            part = np.ascontiguousarray(eight[self.start[at] + step]).view("<u8")[:, 0]
            value[at] = mix(value[at] ^ (part & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))), 12)
            step += 8
            at = at[size[at] > step]
        for k in np.flatnonzero(size > LONG_WORD):
            value[k] = int.from_bytes(hashlib.blake2b(self.data[self.start[k] : self.end[k]].tobytes(), digest_size=8).digest(), "little")
        return value


def gram_sums(words: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``gram_at`` takes the hash of any run of words."""
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(WORD_P, len(words)), out=sums[1:])
    return sums


def gram_at(sums: np.ndarray, at: np.ndarray, n: int | np.ndarray, salt: int = 2) -> np.ndarray:
    """The hash of the ``n`` words from each of ``at``."""
    return mix((sums[at + n] - sums[at]) * powers(WORD_INV, len(sums))[at], salt)


def gram_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all runs of ``n`` words inside a row, and the row of each."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[:-1], count), row


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)
