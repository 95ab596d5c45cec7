"""Words of many texts at once: byte-level numpy over Arrow string buffers.

All word classes used here are unions of ASCII ranges and "every byte from 0x80", so they can be found byte by byte
in UTF-8. A word's 64-bit hash is a polynomial over random byte values, taken from prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 1024

U = np.uint64
_MULT, _BASE = U(0x9E3779B97F4A7C15), 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def mix1(x: int) -> int:
    return int(mix(np.array([x], dtype=U))[0])


BYTE_VALUES = mix((np.arange(256, dtype=U) + U(1)) * _MULT)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A word byte for the class [^\x20\x09-\x0D].
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[32, *range(9, 14)]] = False
#: A word byte for the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[128:] = ALNUM[48:58] = ALNUM[97:123] = True

_powers: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _powers[k] = p
    return _powers[0], _powers[1]


class Words:
    """Words of consecutive texts: ``start``, ``end`` (bytes), ``hash``; text d has the words first[d]:first[d + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(self.data)
        inside = word_bytes[self.data]
        begins, ends = inside.copy(), inside.copy()
        if n > 1:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
        at = offsets[:-1][offsets[:-1] < n]
        begins[at] = inside[at]
        last = offsets[1:][offsets[1:] > 0] - 1
        ends[last] = inside[last]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._sums = None
        self._n = n

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = powers(self._n)
        if self._sums is None:
            self._sums = np.zeros(self._n + 1, dtype=U)
            np.cumsum(BYTE_VALUES[self.data] * up[: self._n], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[start]) * down[start] + (end - start).astype(U) * _MULT)

    @property
    def hash(self) -> np.ndarray:
        if not hasattr(self, "_hash"):
            self._hash = self.span_hash(self.start, self.end)
        return self._hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def word_hash(word: bytes) -> int:
    """The hash that ``Words`` gives this (already lower-cased) word."""
    data = np.frombuffer(word, dtype=np.uint8)
    w = Words(data, np.array([0, len(data)]), np.ones(256, dtype=bool))
    return int(w.span_hash(np.array([0]), np.array([len(data)]))[0])


_POSITION = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def gram_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive entries."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    out = h[:n] * _POSITION[0]
    for k in range(1, size):
        out = out + h[k : k + n] * _POSITION[k]
    return mix(out + U(size))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of pieces of about CHUNK_BYTES and at most CHUNK_DOCS rows."""
    data, offsets = text_buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = max(i + 1, min(j, i + CHUNK_DOCS, n))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def packed(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed: the two low bytes of all, then the two high ones, which are mostly 0."""
    halves = x.astype("<u4").view("<u2")
    return len(x).to_bytes(8, "little") + pa.compress(np.concatenate((halves[0::2], halves[1::2])).tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    halves = np.frombuffer(pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True), dtype="<u2") if n else np.zeros(0, dtype="<u2")
    return halves[:n].astype(np.uint32) | (halves[n:].astype(np.uint32) << np.uint32(16))
