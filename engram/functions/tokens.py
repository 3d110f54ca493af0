"""Token counters: byte-level BPE from a public vocabulary file, or a token for every four characters."""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql.types import LongType, StringType

from .slices import by_slices

VOCABULARY = "byte_bpe_50k.tiktoken"
#: The last place of a text at which a word certainly begins, as far as there is an ASCII letter.
LAST_WORD = re.compile(r".*[!-~] [A-Za-z]", re.S)


class Counter(Protocol):
    """What chunking needs of a tokenizer."""

    def count(self, text: str) -> int: ...

    def pieces(self, text: str, size: int) -> list[str]:
        """Consecutive parts of `size` tokens each."""

    def ruler(self, text: str) -> Callable[[int, int, int | None], int]:
        """A function that gives the tokens of a part text[a:b]; with a limit, that number or another on the same side of the limit. The text is encoded once for all parts."""


class Characters:
    """A token for every four characters."""

    def count(self, text: str) -> int:
        return len(text) // 4

    def pieces(self, text: str, size: int) -> list[str]:
        return [text[i : i + 4 * size] for i in range(0, len(text), 4 * size)]

    def ruler(self, text: str) -> Callable[[int, int, int | None], int]:
        return lambda a, b, limit=None: (b - a) // 4


class Bpe:
    """Byte-level BPE; special tokens' names in a text are ordinary text."""

    def __init__(self, file: str):
        import public_tokenizers
        import tiktoken

        path = file if "/" in file else public_tokenizers.path(file)
        with open(path, encoding="ascii") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(str.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.last: tuple = (None, None)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, rank in ranks.items():
            self.sizes[rank] = len(word)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def pieces(self, text: str, size: int) -> list[str]:
        ids = self.encoding.encode_ordinary(text)
        return [self.encoding.decode(ids[i : i + size]) for i in range(0, len(ids), size)]

    def _starts(self, text: str) -> tuple[list[int], list[int]]:
        """Blanks of a text that certainly begin a word, and the tokens before each; kept for the last text, which is packed by paragraphs and then by sentences."""
        if text != self.last[0]:
            try:
                raw = np.frombuffer(text.encode(), np.uint8)
            except UnicodeEncodeError:  # half a pair of surrogates
                return [], []
            visible, letter = (raw > 0x20) & (raw < 0x7F), (raw | 0x20) - np.uint8(0x61) < 26
            at = np.flatnonzero((raw[1:-1] == 0x20) & visible[:-2] & letter[2:]) + 1
            ends = np.cumsum(self.sizes[self.encoding.encode_to_numpy(text, disallowed_special=())])
            places = at if text.isascii() else np.searchsorted(np.flatnonzero((raw & 0xC0) != 0x80), at)
            self.last = text, (places.tolist(), np.searchsorted(ends, at, side="right").tolist())
        return self.last[1]

    def ruler(self, text: str) -> Callable[[int, int, int | None], int]:
        """Tokens never cross the words that the vocabulary's pattern finds; a blank between a visible ASCII character and an ASCII letter always begins one, whatever stands around.

        So the text is encoded once, and a part has as many tokens as the text
        between the first and the last such blank of the part, and as its two
        ends; an end has no more tokens than bytes.
        """
        places, before, begin, head = None, None, -1, (0, 0)

        def measure(a: int, b: int, limit: int | None = None) -> int:
            nonlocal places, before, begin, head
            if places is None:
                if limit is not None and b - a > 16 * limit:  # its beginning may be above the limit already
                    m = LAST_WORD.search(text, a, a + 8 * limit)
                    n = self.count(text[a : m.end() - 2]) if m else 0
                    if n > limit:
                        return n
                places, before = self._starts(text)
            i, j = bisect_right(places, a) if a != begin else head[0], bisect_left(places, b - 1) - 1  # a blank has a letter after it
            if i > j:
                return self.count(text[a:b])
            if a != begin:
                begin, head = a, (i, self.count(text[a : places[i]]))
            n = head[1] + before[j] - before[i]
            end = text[places[j] : b]
            if limit is not None and n + 4 * len(end) <= limit:
                return n + 4 * len(end)
            return n + self.count(end)

        return measure


@lru_cache(8)
def counter(vocabulary: str | None = VOCABULARY) -> Counter:
    """This worker's counter for a vocabulary file; characters for None."""
    return Characters() if vocabulary is None else Bpe(vocabulary)


def count_tokens(vocabulary: str | None = VOCABULARY):
    """A column function: tokens of a text; null for null."""

    def compute():
        count = counter(vocabulary).count
        return lambda texts: [None if t is None else count(t) for t in texts]

    return by_slices(compute, LongType(), pa.int64())


def truncate_tokens(limit: int, vocabulary: str | None = VOCABULARY):
    """A column function: the first `limit` tokens of a text."""

    def compute():
        c = counter(vocabulary)
        return lambda texts: [t if t is None or len(t.encode()) <= limit or c.count(t) <= limit else c.pieces(t, limit)[0] for t in texts]

    return by_slices(compute, StringType(), pa.string())
