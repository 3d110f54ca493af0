"""Encoding whole texts with a public tokenizer, at the speed of a dictionary.

White space separates tokens in these vocabularies, so a text's ids are its
words' ids in a row. A worker encodes every distinct word once with the
tokenizers library and keeps its bytes and ids; a chunk of texts is then a few
vectorised gathers. Words are found by a hash under a key that each worker draws
for itself, and compared byte for byte with what is remembered. The memory of
words is bounded and only saves time.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from .text import Words, chunks, ranges

VOCABULARY = "word_bpe_49k.json"
#: Distinct words that a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
REMEMBERED_PIECES = 150_000
REMEMBERED_BYTES = 64 << 20
_SIMPLE = re.compile(rb"([a-z]+)([.,!?;:*#%&$]*)")


class Encoder:
    """Ids of texts under a vocabulary file of the tokenizers library."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """This worker's encoder for a file of `public_tokenizers`, or for a path."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        at = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(at)
        self._forget()

    def _forget(self) -> None:
        """Known words are arrays sorted by hash: their hash, where their ids start in the pool and how many there are, and the same for their bytes."""
        self.key = int.from_bytes(os.urandom(8), "little")
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.at, self.length = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 18, np.int32), 0
        self.spelt, self.written = np.zeros(1 << 20, np.uint8), 0
        self.pieces: dict[bytes, list[int]] = {}

    def _piece(self, piece: bytes) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= REMEMBERED_PIECES:
                self.pieces.clear()
            ids = self.pieces[piece] = [t.id for t in self.tokenizer.model.tokenize(piece.decode())]
        return ids

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """A word of ASCII letters and closing marks is two pieces for the model; any other goes through the whole tokenizer."""
        found: list[list[int] | None] = []
        rest = []
        for i, w in enumerate(words):
            m = _SIMPLE.fullmatch(w)
            if m:
                found.append(self._piece(m[1]) + (self._piece(m[2]) if m[2] else []))
            else:
                found.append(None)
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False), strict=True):
            found[i] = e.ids
        size = np.array([len(f) for f in found], np.int32)
        flat = np.array([t for f in found for t in f], np.int32)
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        first = (self.used + np.cumsum(size) - size).astype(np.int32)
        self.used += len(flat)
        length = np.array([len(w) for w in words], np.int32)
        spelt = np.frombuffer(b"".join(words), np.uint8)
        while self.written + len(spelt) > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        self.spelt[self.written : self.written + len(spelt)] = spelt
        starts = (self.written + np.cumsum(length) - length).astype(np.int32)
        self.written += len(spelt)
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.first, self.size, self.at, self.length = (
            np.insert(old, at, new[order]) for old, new in ((self.known, hashes), (self.first, first), (self.size, size), (self.at, starts), (self.length, length))
        )

    def _same(self, w: Words, words: np.ndarray, slots: np.ndarray) -> bool:
        """Whether these words are spelt like the known ones in `slots`."""
        length = w.ends[words] - w.starts[words]
        return bool((length == self.length[slots]).all() and (w.lowered(words) == self.spelt[ranges(self.at[slots], length)]).all())

    def _chunk(self, texts: list[bytes], with_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        w = Words(texts, key=self.key)
        codes, distinct = pd.factorize(w.hashes)
        if len(self.known) and (len(self.known) + len(distinct) > REMEMBERED or self.written > REMEMBERED_BYTES):
            self._forget()
            return self._chunk(texts, with_ids)
        if len(self.known):
            new = self.known[np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)] != distinct
        else:
            new = np.ones(len(distinct), bool)
        at = np.empty(len(distinct), np.int64)
        at[codes[::-1]] = np.arange(len(codes))[::-1]
        if new.any():
            self._learn(distinct[new], [w.word(a).lower() for a in at[new].tolist()])
        slots = np.searchsorted(self.known, distinct)
        if not self._same(w, at, slots):  # two words of one hash: start afresh under another key
            self._forget()
            return self._chunk(texts, with_ids)
        sizes = self.size[slots][codes].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(ends[w.bounds])
        if not with_ids:
            return counts, None
        at = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.first[slots][codes], sizes)
        return counts, self.pool[at]

    def encode(self, texts: list[bytes], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """The number of ids of each text, and all ids in a row."""
        counts, ids = [], []
        for lo, hi in chunks(texts):
            part = texts[lo:hi]
            special = [i for i, t in enumerate(part) if b"<|" in t]  # a special token's name depends on case
            if not special:
                c, i = self._chunk(part, with_ids)
                counts.append(c)
                ids.append(i)
                continue
            for i, t in enumerate(part):
                if i in special:
                    e = np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)
                    counts.append(np.array([len(e)]))
                    ids.append(e)
                else:
                    c, e = self._chunk([t], with_ids)
                    counts.append(c)
                    ids.append(e)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return n, (np.concatenate(ids) if ids else np.zeros(0, np.int32)) if with_ids else None
