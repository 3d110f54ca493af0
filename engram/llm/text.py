"""Vectorised word and shingle hashing over batches of whole texts.

Words are runs of bytes other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased;
all of these are ASCII, so working on UTF-8 bytes equals working on characters.
A word's hash is the sum over its bytes of a random number for the byte times a
random odd number for its place in the word, modulo 2**64, mixed together with
the word's length. Unlike a polynomial modulo 2**64 it has no built-in
collisions between words of a regular pattern.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_U = np.uint64

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_LOWER_BYTE = _LOWER.astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random number for each byte, none for white space; and odd ones for the places of a word.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[~_WORD] = 0
_BYTE_LOWER = _BYTE[_LOWER]


def _odd(n: int, key: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F) + _U(key)) | _U(1)


_places = lru_cache(4)(_odd)


def _place_numbers(n: int, key: int) -> np.ndarray:
    return _places(4096, key) if n <= 4096 else _odd(n, key)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null gives the empty text."""
    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, where a step's output is as large as its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about `limit` bytes each; a longer text stands alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """The words of a run of texts: byte ranges in `buf`, hashes under `key`, and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = True, key: int = 0):
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, dtype=np.uint8)
        n = len(self.buf)
        inside = _WORD[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[::2].copy(), edge[1::2].copy()
        at = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bounds = np.searchsorted(self.starts, at)
        length = self.ends - self.starts
        self.hashes = np.zeros(0, _U)
        if len(length):
            first = self.starts[0]
            begin = (self.starts - first).astype(np.int32)
            place = np.arange(n - first, dtype=np.int32) - np.repeat(begin, np.diff(begin, append=n - first))
            values = np.take(_BYTE_LOWER if lower else _BYTE, self.buf[first:]) * np.take(_place_numbers(int(length.max()), key), place, mode="clip")
            self.hashes = mix(np.add.reduceat(values, begin) + length.astype(_U) * _U(0xD6E8FEB86659FD93))

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def lowered(self, words: np.ndarray) -> np.ndarray:
        """The bytes of some words in a row, A-Z lower-cased."""
        return _LOWER_BYTE[self.buf[ranges(self.starts[words], self.ends[words] - self.starts[words])]]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for `length[0]` numbers, then those of the next range."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


def _weights(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word sequences, in text order; a shorter text has its whole sequence as one."""
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=_U)
    k, mark = min(k, n), n if n < k else 0
    w = _weights(k)
    out = np.full(n - k + 1, mark, dtype=_U) * _U(0x8BB84B93962EACC9)
    for i in range(k):
        out += words[i : n - k + 1 + i] * w[i]
    return mix(out)


def shingled(texts: list[bytes], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its row and its k-word hashes in text order."""
    for lo, hi in chunks(texts):
        w = Words(texts[lo:hi])
        for i in range(hi - lo):
            yield lo + i, ngrams(w.hashes[w.bounds[i] : w.bounds[i + 1]], k)


def digest(hashes: np.ndarray) -> int:
    """A signed 64-bit digest of a sequence of hashes."""
    n = len(hashes)
    at = np.arange(1, n + 1, dtype=_U) * _U(0xE7037ED1A0B428DB)
    total = int(np.add.reduce(mix(hashes ^ mix(at)), dtype=_U)) if n else 0
    return int(mix(np.array([(total + n * 0x9FB21C651E98DF25) & (2**64 - 1)], dtype=_U)).view(np.int64)[0])
