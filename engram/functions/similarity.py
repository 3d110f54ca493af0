"""String and vector similarity."""

from __future__ import annotations

from collections.abc import Callable
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each lower-cased word, padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Common share of two trigram sets; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different dimensions, a zero norm, nulls or NaN."""
    raw = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when(F.size(a) != F.size(b), 0.0).otherwise(F.nanvl(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)))


def jaro_winkler_of(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, matched = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                matched.append(c)
                break
    m = len(matched)
    if not m:
        return 0.0
    other = [c for c, t in zip(b, taken, strict=True) if t]
    swaps = sum(x != y for x, y in zip(matched, other, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_against(names: list[str]) -> Callable[[str, np.ndarray], np.ndarray]:
    """A function that scores a text against the `names` at some places, as `jaro_winkler_of` does; places in a name are the bits of a number, so longer names than 64 go one by one."""
    length, begin = np.array([len(n) for n in names], np.int64), commonprefix(names)
    places: dict[str, np.ndarray] = {}
    for at, name in enumerate(names):
        if len(name) <= 64:
            for i, c in enumerate(name):
                if c not in places:
                    places[c] = np.zeros(len(names), np.uint64)
                places[c][at] |= np.uint64(1 << i)
    heads = np.array([[ord(c) for c in n[:4]] + [-1] * (4 - len(n[:4])) for n in names], np.int64).reshape(len(names), 4)

    def of_one_length(a: str, at: np.ndarray, size: int) -> np.ndarray:
        reach, none = max(max(len(a), size) // 2 - 1, 0), np.zeros(len(at), np.uint64)
        own = {c: places[c][at] if c in places else none for c in set(a)}
        same = len(commonprefix([a, begin]))  # these characters take each other
        free, taken, todo = np.full(len(at), 2**64 - (1 << same), np.uint64), [], a[same:]
        for i, c in enumerate(todo, same):
            near = ((1 << min(i + reach + 1, 64)) - 1) & ~((1 << max(0, i - reach)) - 1) & (2**64 - 1)
            bit = own[c] & free & np.uint64(near)
            bit &= ~bit + np.uint64(1)  # the lowest one
            free ^= bit
            taken.append(bit)
        m, swaps, rest = np.full(len(at), same), np.zeros(len(at), np.int64), ~free ^ np.uint64((1 << same) - 1)
        for c, bit in zip(todo, taken, strict=True):
            there = bit != 0
            first = rest & (~rest + np.uint64(1))
            m += there
            swaps += there & (own[c] & first == 0)
            rest ^= np.where(there, first, np.uint64(0))
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / max(len(a), 1) + m / max(size, 1) + (m - swaps // 2) / some) / 3, 0.0)
        head = np.array([ord(c) for c in a[:4]] + [-2] * (4 - len(a[:4])), np.int64)
        prefix = np.cumprod(heads[at] == head, axis=1).sum(axis=1)
        return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)

    def scores(a: str, at: np.ndarray) -> np.ndarray:
        out, sizes = np.zeros(len(at)), length[at]
        for size in np.unique(sizes).tolist():
            where = np.flatnonzero(sizes == size)
            out[where] = of_one_length(a, at[where], size) if size <= 64 else [jaro_winkler_of(a, names[j]) for j in at[where].tolist()]
        return out if a else np.where(sizes == 0, 1.0, 0.0)

    return scores


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler similarity with the prefix boost above 0.7."""
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    s = (1 << len(a)) - 1
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u) | (s - u)
    return len(a) - bin(s & ((1 << len(a)) - 1)).count("1")


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * longest common subsequence / total length; 1 for two empty strings."""
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2 * _lcs(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def composite(cos: Column, name: Column, same_run: Column, same_owner: Column) -> Column:
    """Ordering score of a pair in a batch; never a filter."""
    return 0.4 * cos + 0.3 * name + 0.2 * same_run.cast("double") + 0.1 * same_owner.cast("double")


def ratio(a: str, b: str) -> float:
    """2 * longest common subsequence / total length; 1 for two empty strings."""
    return 2 * _lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one; windows may hang over either end."""
    a, b = sorted((a, b), key=len)
    if not a:
        return float(not b)
    both = lambda x, y: max((ratio(x, y[max(0, i) : i + len(x)]) for i in range(1 - len(x), len(y))), default=0.0)
    return max(both(a, b), both(b, a)) if len(a) == len(b) else both(a, b)


def weighted_ratio(a: str, b: str) -> float:
    """The best of whole, word-wise and partial ratios; the latter weigh less, and count only for lengths that differ by half or more."""
    if not a or not b:
        return 0.0
    x, y = a.split(), b.split()
    common, only_x, only_y = (sorted(w) for w in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    sect, rest_x, rest_y = " ".join(common), " ".join(only_x), " ".join(only_y)
    x, y = " ".join(sorted(x)), " ".join(sorted(y))
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    if lengths < 1.5:
        full_x, full_y = f"{sect} {rest_x}".strip(), f"{sect} {rest_y}".strip()
        by_set = [ratio(full_x, full_y)] if only_x and only_y else [1.0] if common else [0.0]
        by_set += [ratio(sect, full_x), ratio(sect, full_y)] if common else []
        return max(ratio(a, b), 0.95 * max(ratio(x, y), *by_set))
    weight = 0.9 if lengths <= 8 else 0.6
    by_word = 1.0 if common else max(partial_ratio(x, y), partial_ratio(rest_x, rest_y))
    return max(ratio(a, b), weight * partial_ratio(a, b), 0.95 * weight * by_word)
