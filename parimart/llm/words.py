"""Words and shingles of Arrow text columns as 64-bit hashes, in numpy, a block of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.Generator(np.random.PCG64(20))
_ORDER = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
#: The first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a text column, nulls as empty texts; the bytes aren't copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), places


def blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` bytes together, or a single longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def hash_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings at ``start``, eight bytes at a time."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(eight[start] & _FIRST[np.minimum(size, 8)])
    at, live = 8, np.flatnonzero(size > 8)
    while len(live):
        part = eight[start[live] + at] & _FIRST[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] * _U(0x9E3779B97F4A7C15) + part)
        at += 8
        live = live[size[live] > at]
    return mix(h + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


class Words:
    """The words (runs of anything but ASCII white space) of a block of texts, in order."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = data[offsets[0] : offsets[-1]]
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        ink = ~SPACE[self.data]
        edge = np.flatnonzero(ink[1:] != ink[:-1]) + 1
        if n and ink[0]:
            edge = np.concatenate([[0], edge])
        if n and ink[-1]:
            edge = np.append(edge, n)
        self.start, self.end = edge[::2], edge[1::2]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        cuts = np.unique(cuts[ink[cuts] & ink[cuts - 1]])  # texts that meet without white space between them
        if len(cuts):
            self.start = np.insert(self.start, np.searchsorted(self.start, cuts), cuts)
            self.end = np.insert(self.end, np.searchsorted(self.end, cuts), cuts)
        self.count = np.diff(np.searchsorted(self.start, self.offsets))
        self.text = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = hash_words(self.data, self.start, self.end - self.start)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(hashes, offsets)``: each text's runs of ``k`` words, or all its words if there are fewer; with repeats."""
        h, n = self.hash, len(self.hash)
        m = max(0, n - k + 1)
        v = np.zeros(m, np.uint64)
        for i in range(k):
            v += h[i : i + m] * _ORDER[i]
        v = mix(v + _U(k))
        v, of = v[self.text[:m] == self.text[k - 1 :][:m]], self.text[:m][self.text[:m] == self.text[k - 1 :][:m]]
        few = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(few):
            at = np.cumsum(self.count) - self.count
            short = [np.sum(h[at[t] : at[t] + self.count[t]] * _ORDER[: self.count[t]], dtype=np.uint64) + _U(self.count[t]) for t in few]
            v, of = np.concatenate([v, mix(np.array(short, np.uint64))]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            v, of = v[order], of[order]
        return v, np.searchsorted(of, np.arange(len(self.offsets)))

    def sets(self, k: int) -> list[np.ndarray]:
        """Each text's distinct shingles, in order of hash."""
        v, at = self.shingles(k)
        return [np.unique(v[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
