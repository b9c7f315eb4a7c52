"""Vectorised text primitives over Arrow string arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; no byte of a multi-byte UTF-8
character is one of these, so whole words come out. Words, shingles and windows are named by 64-bit
polynomial hashes that depend on the content alone, hence agree between all tasks.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _WORD_BASE = U(0x9E3779B97F4A7C55), U(0xD1342543DE82EF95)
#: Bytes of text that are worked on at a time; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (the splitmix64 steps)."""
    x = x ^ U(salt & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, kept for the longest request so far."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, self.base, U)])
            self.down = np.multiply.accumulate(np.r_[U(1), np.full(size - 1, U(_inverse(int(self.base))), U)])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS, _WORDS2 = Powers(_BASE), Powers(_WORD_BASE), Powers(U(0xC2B2AE3D27D4EB4F))


@dataclass
class Words:
    """Words of consecutive texts: byte spans in buf, and word offsets of the texts."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray  # text i has words offsets[i]:offsets[i + 1]

    def hashes(self) -> np.ndarray:
        up, down = _BYTES.get(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum((self.buf.astype(U) + U(1)) * up[:-1], out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


_SEEN = [0]


def release(done: int, every: int = 32 << 20) -> None:
    """Give memory that is free in this process back to the machine after so many bytes of text."""
    _SEEN[0] += done
    if _SEEN[0] >= every:
        _SEEN[0] = 0
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


#: What operators remember in this process, by operator, as functions that drop it.
_FORGET: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def enter(operator: str) -> None:
    """Begin a task of this operator: what others remember in this process goes."""
    if _OWNER[0] != operator:
        _OWNER[0] = operator
        for name, forget in _FORGET.items():
            if name != operator:
                forget()
        release(0, 0)


def remember(operator: str, forget: Callable[[], None]) -> None:
    _FORGET[operator] = forget


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string array; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    data = column.buffers()[2]
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with at most limit bytes; a longer text stands alone."""
    data, offsets = string_parts(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        release(int(offsets[j] - offsets[i]))
        i = j


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def split_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return Words(buf, starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def window_hashes(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of words[i:i+n] for each i; windows that cross texts are the caller's to discard."""
    if len(words) < n:
        return np.zeros(0, U)
    powers = _WORDS2 if second else _WORDS
    if n <= 8:
        up, _ = powers.get(n + 1)
        total = np.zeros(len(words) - n + 1, U)
        for k in range(n):
            total += words[k : len(words) - n + 1 + k] * up[n - 1 - k]
    else:
        up, down = powers.get(len(words) + 1)
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(words * up[:-1], out=sums[1:])
        total = (sums[n:] - sums[:-n]) * down[: len(words) - n + 1]
    return mix(total, n * 0x632BE59BD9B4E019)


@dataclass
class ShingleSets:
    """Sorted distinct shingle hashes of each text: text i has values[offsets[i]:offsets[i + 1]]."""

    values: np.ndarray
    offsets: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, salt: int) -> np.ndarray:
        """An order-free 64-bit name of each set."""
        total = np.zeros(len(self.values) + 1, U)
        np.cumsum(mix(self.values, salt), out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def shingle_sets(words: Words, n: int) -> ShingleSets:
    """Distinct n-word shingles; a text of 1 to n - 1 words has one shingle, the whole sequence."""
    h, offsets = words.hashes(), words.offsets
    counts = np.diff(offsets)
    per = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(per, out=out[1:])
    grams = window_hashes(h, n)
    values = np.empty(out[-1], U)
    long = np.repeat(counts >= n, per)
    source = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], per)
    values[long] = grams[source[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        values[out[i]] = window_hashes(h[offsets[i] : offsets[i + 1]], int(counts[i]))[0]
    for a, b in zip(out[:-1].tolist(), out[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    fresh[out[:-1][per > 0]] = True
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(fresh, out=total[1:])
    return ShingleSets(values[fresh], total[out])
