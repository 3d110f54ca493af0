"""Alike names without all pairs: an exact filter for Jaro-Winkler similarity, and an equi-join on what passes it.

A Jaro-Winkler similarity of `t` with a common beginning of p characters needs a
Jaro similarity of (t - p/10) / (1 - p/10), and that needs names to have a
number of characters in common that follows from their lengths. So for each pair
of lengths and each kind of beginning (any, two equal characters, four) there is
a least overlap of the names' characters, counted with repeats. If two sets
overlap in `need`, their first (size - need + l) members, rarest first, overlap
in l; every l of them together, with the beginning and the lengths, are a
signature, and names that are alike enough share one. Candidates come from an
equi-join on signatures and are scored once each.

The most alike name of each mention is looked for from high similarities down;
a step takes only mentions that no step before it has answered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from hashlib import blake2b
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import jaro_winkler_of
from ..sources.storage import written

#: Equal first characters that a kind of beginning asks for, and the longest beginning that counts in it.
HEADS = ((0, 1), (2, 3), (4, 4))
#: Similarities from which mentions are answered, one step each.
STEPS = (0.97, 0.95, 0.91, 0.85)
#: Signatures of a name for one pair of lengths, at most, where longer ones are to be had.
SIGNATURES = 24
#: Lengths up to this stand for themselves, longer ones are taken together by tenths.
EXACT_LENGTH = 32
#: Repeats of a character that are told apart when characters are ordered by rarity.
REPEATS = 8
#: Pairs to score for each row up to which signatures are worth their join.
PAIRS_A_ROW = 32


def band(n: int) -> int:
    """A number for lengths that are taken together."""
    return n if n <= EXACT_LENGTH else EXACT_LENGTH + 1 + int(log(n / (EXACT_LENGTH + 1)) / log(1.1))


def shortest(of: int) -> int:
    """The least length of a band."""
    if of <= EXACT_LENGTH:
        return of
    n = max(EXACT_LENGTH + 1, int((EXACT_LENGTH + 1) * 1.1 ** (of - EXACT_LENGTH - 1)) - 1)
    while band(n) < of:
        n += 1
    return n


def least_common(a: int, b: int, least: float, head: int) -> int:
    """Characters that names of lengths a and b have in common if they are `least` alike with a common beginning of `head`."""
    jaro = (least - 0.1 * head) / (1 - 0.1 * head)
    return max(1, ceil((3 * jaro - 1) * a * b / (a + b) - 1e-9))


class Signatures:
    """The signatures of names for one least similarity, which is above 0.82."""

    def __init__(self, least: float, rank: dict[tuple[str, int], int]):
        self.least, self.rank = least, rank
        self.plans: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}

    def _plan(self, of: int) -> list[tuple[int, int, int, int]]:
        """(kind, other band, need, members of a signature) for each band of lengths that a name of band `of` may be alike with."""
        if of not in self.plans:
            own, out = shortest(of), []
            for kind, (equal, most) in enumerate(HEADS):
                jaro = (self.least - 0.1 * most) / (1 - 0.1 * most)
                reach = 3 * jaro - 2  # the shorter name is this share of the longer, at least
                longest = shortest(of + 1) - 1
                for other in range(band(max(1, int(own * reach))), band(ceil(longest / reach) + 1) + 1):
                    lo, hi = sorted((own, shortest(other)))
                    top = max(longest, shortest(other + 1) - 1)
                    need = least_common(lo, hi, self.least, most)
                    if need > min(longest, shortest(other + 1) - 1) or min(longest, shortest(other + 1) - 1) < equal:
                        continue
                    together = 1
                    while together < min(need, lo) and comb(top - need + together + 1, together + 1) <= SIGNATURES:
                        together += 1
                    out.append((kind, other, need, together))
            self.plans[of] = out
        return self.plans[of]

    def of(self, name: str) -> np.ndarray:
        """Signatures as numbers: sums of random numbers of the members, with one of the beginning and the lengths."""
        seen: Counter = Counter()
        members = []
        for c in name:
            seen[c] += 1
            members.append((c, seen[c]))
        members.sort(key=lambda m: (self.rank.get((m[0], min(m[1], REPEATS)), -1), m))
        numbers = np.array([_number(m) for m in members], np.uint64)
        own, size, parts = band(len(name)), len(name), []
        for kind, other, need, together in self._plan(own):
            equal = HEADS[kind][0]
            first = min(size, size - need + together)
            if size < equal or need > size or first < together:
                continue
            tag = np.uint64(_number((kind, min(own, other), max(own, other), name[:equal])))
            parts.append(numbers[_choices(first, together)].sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ tag)
        return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)


@lru_cache(1 << 16)
def _number(value: tuple) -> int:
    """64 random bits of a value, the same in every process; a collision only costs a comparison."""
    return int.from_bytes(blake2b(repr(value).encode(), digest_size=8).digest(), "little")


@lru_cache(4096)
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def _rarity(names: DataFrame) -> dict[tuple[str, int], int]:
    """Places of (character, repeat) from rare to frequent; as many as the alphabet has characters, times `REPEATS`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for name in batch.column("name").to_pylist():
                seen.update((c, min(i + 1, REPEATS)) for c, n in Counter(name).items() for i in range(n))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["c", "i", "n"])

    rows = names.mapInArrow(count, "c string, i int, n bigint").groupBy("c", "i").agg(F.sum("n").alias("n")).collect()
    return {(r.c, r.i): at for at, r in enumerate(sorted(rows, key=lambda r: (r.n, r.c, r.i)))}


def candidates(left: DataFrame, right: DataFrame, least: float, rank: dict[tuple[str, int], int]) -> DataFrame:
    """(a, b): each pair of texts of `left` (name) and `right` (name) that shares a signature, once; no pair that is `least` alike is missing."""
    signatures = Signatures(least, rank)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                names = batch.column("name").slice(at, 256)
                found = [signatures.of(n) for n in names.to_pylist()]
                where = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(where)), pa.array(np.concatenate(found))], names=["name", "signature"])

    both = [df.select("name").filter("name <> ''").mapInArrow(signed, "name string, signature bigint").withColumnRenamed("name", side) for df, side in ((left, "a"), (right, "b"))]
    return both[0].join(both[1], "signature").select("a", "b").distinct()


def tell_apart(mentions: DataFrame, names: DataFrame, sizes: tuple[int, int], step: float = STEPS[-1], some: int = 2000) -> bool:
    """Whether signatures leave fewer pairs of `mentions` and `names` than `PAIRS_A_ROW` for each row, by a sample of both; what is found doesn't depend on it."""
    drawn = [df.filter(F.pmod(F.xxhash64(c), F.lit(max(1, n // some))) == 0).select(F.col(c).alias("name")).distinct() for df, c, n in ((mentions, "mention", sizes[0]), (names, "name", sizes[1]))]
    shares = [min(1.0, some / n) for n in sizes]
    return candidates(*drawn, step, _rarity(drawn[1])).count() <= PAIRS_A_ROW * sum(sizes) * shares[0] * shares[1]


def alike(left: DataFrame, right: DataFrame, least: float, rank: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """(a, b, score): all pairs of distinct texts of `left` and `right` (name) whose Jaro-Winkler similarity is `least` or more, `least` above 0.82. Empty and null names have no pair."""
    left, right = left.select("name").distinct(), right.select("name").distinct()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(a, b, s) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True) if (s := jaro_winkler_of(a, b)) >= least]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["a", "b", "score"])

    rank = _rarity(right.filter("name is not null")) if rank is None else rank
    return candidates(left, right, least, rank).mapInArrow(score, "a string, b string, score double")


def most_alike(mentions: DataFrame, names: DataFrame, least: float = STEPS[-1]) -> DataFrame:
    """(mention_id, entity_id, score): of each mention (mention_id, mention, latin) the most alike name (entity_id, name, latin) if `least` alike or more, then the smallest id.

    The score is the best of the two as they are and of either one in Latin
    letters with the other as it is. Null and empty names take no part.
    """
    open_, answers = mentions.select("mention_id", "mention", F.coalesce("latin", "mention").alias("latin")).filter("mention is not null"), []
    open_, names = written(open_, "open"), written(names.filter("name is not null").select("entity_id", "name", F.coalesce("latin", "name").alias("latin")), "names")
    rank = _rarity(names.select(F.explode(F.array("name", "latin")).alias("name")).distinct())
    ways = [("mention", "name", open_, names)]
    for mine, theirs in (("latin", "name"), ("mention", "latin")):
        l, r = (open_.filter("latin <> mention"), names) if mine == "latin" else (open_, names.filter("latin <> name"))
        ways += [(mine, theirs, l, r)] * (not (l if mine == "latin" else r).isEmpty())
    for step in [s for s in STEPS if s > least] + [least]:
        if open_.isEmpty():
            break
        pairs = []
        for mine, theirs, asked, known in ways:
            l, r = asked.join(open_.select("mention_id"), "mention_id", "left_semi").select("mention_id", F.col(mine).alias("a")), known.select("entity_id", F.col(theirs).alias("b"))
            found = alike(l.withColumnRenamed("a", "name"), r.withColumnRenamed("b", "name"), step, rank)
            pairs.append(found.join(l, "a").groupBy("mention_id", "b").agg(F.max("score").alias("score")).join(r, "b").select("mention_id", "entity_id", "score"))
        best = reduce(DataFrame.unionByName, pairs).groupBy("mention_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "entity_id")).alias("b"))
        answers.append(written(best.select("mention_id", F.col("b.entity_id").alias("entity_id"), (-F.col("b.s")).alias("score")), "alike"))
        open_ = written(open_.join(answers[-1], "mention_id", "left_anti"), "open")
    kinds = dict(mentions.dtypes)["mention_id"], dict(names.dtypes)["entity_id"]
    none = mentions.sparkSession.createDataFrame([], f"mention_id {kinds[0]}, entity_id {kinds[1]}, score double")
    return reduce(DataFrame.unionByName, answers, none)
