"""Vectorised word kernels used inside Arrow tasks.

A text's words are the maximal stretches of bytes outside ``[\\x20\\x09-\\x0D]``
in its UTF-8 form.  Texts come in slices of bounded size (``slices``), so that
the numpy work arrays of a task do not grow with the Arrow batch.

Null and empty texts have no words.  Very long texts make a slice of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: True where a lower-cased byte is no part of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
NOT_PLAIN = np.ones(256, dtype=bool)
NOT_PLAIN[48:58] = NOT_PLAIN[97:123] = NOT_PLAIN[128:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _S33
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def combine(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Name of the ordered pair (a, b); differs from the name of (b, a)."""
    salt = np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + salt))


class Words:
    """The words of some texts: ``data[start[i]:end[i]]`` is word i, of text ``doc[i]``.

    ``first[d]:first[d + 1]`` are the words of text d.  ``lower`` lower-cases A-Z first;
    ``apart`` marks the bytes that stand between words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = _SPACE):
        self.raw = data
        data = _LOWER[data] if lower else data
        self.data = data
        self.n = len(offsets) - 1
        space = apart[data]
        word = ~space
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[0] = len(data) > 0 and word[0]
        edge[1:-1] = word[1:] & space[:-1]
        edge[-1] = False
        inner = offsets[1:-1]
        inner = inner[inner < len(data)]
        edge[inner] |= word[inner]
        self.start = np.flatnonzero(edge)
        stop = np.zeros(len(data) + 1, dtype=bool)
        stop[1:-1] = space[1:] & word[:-1]
        stop[-1] = len(data) > 0 and word[-1]
        after = offsets[1:-1]
        after = after[after > 0]
        stop[after] |= word[after - 1]
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n), self.count)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit name for each word: multilinear hash over its bytes, then mixed."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        size = self.end - self.start
        most = int(size.max())
        key = mix(np.arange(1, most + 1, dtype=np.uint64) * _GOLD + np.uint64(seed * 7919 + 17))
        inside = np.repeat(self.start, size)
        total = len(inside)
        begin = np.cumsum(size) - size
        at = np.arange(total) - np.repeat(begin, size)
        value = (self.data[inside + at].astype(np.uint64) + np.uint64(1)) * key[at]
        return mix(np.add.reduceat(value, begin) + size.astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into slices of about ``most`` bytes: (from, to, bytes, offsets from 0)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, whole[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to
