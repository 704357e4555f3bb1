"""Whole Arrow batches of UTF-8 text as numpy arrays: words, hashes and windows without
a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once (a longer text is worked on alone).
CHUNK = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base, and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(n + CHUNK // 8, base, np.uint64)
            grown[0] = 1
            _powers[i] = np.multiply.accumulate(grown)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes so that any of their bits can be used alone."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Ranges:
    """Polynomial hashes of any range of a sequence of 64-bit values, from one running sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_table(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte to normalised byte, and whether a byte belongs to a word.  "alnum": A-Z lowered,
    words of 0-9, a-z and all beyond ASCII.  "space": words of all but white space.  "lower":
    the same, A-Z lowered."""
    t, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    if kind != "space":
        t[65:91] += 32
    if kind == "alnum":
        inside[:48] = inside[58:65] = inside[91:97] = inside[123:128] = False
    else:
        inside[[9, 10, 11, 12, 13, 32]] = False
    return t, inside


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


class Words:
    """Words of a chunk: start, end (byte positions), doc (row in the chunk), first (index of
    each row's first word, one more at the end), norm (normalised bytes), inside (word bytes)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        self.norm = table[0][data]
        inside = table[1][data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        self.first = np.searchsorted(self.start, offsets, "left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.inside = inside

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each normalised word."""
        return Ranges(byte_values(self.norm)).hash(self.start, self.end)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each: bytes, and each word's start and end in them."""
        length = self.end - self.start
        begin = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length + 1, out=begin[1:])
        out = np.full(begin[-1], 32, np.uint8)
        which = np.repeat(np.arange(len(length)), length)
        out[np.arange(len(which)) + which] = self.norm[self.inside]
        return out, begin[:-1], begin[:-1] + length


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i + 1]] for each i."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
