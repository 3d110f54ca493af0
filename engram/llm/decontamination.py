"""Benchmark decontamination: seeds of rare word pairs, then Smith-Waterman alignment.

The test items are the query set; they are few, and are taken in blocks of a
fixed size, each sent to every task. With match 2, mismatch and gap -1, an
alignment of m matches, e other steps and score 2m - e >= 2 * least * size has at
least `least` * size - 1 pairs of successive matches with one step or none
between them, because the others cost two steps each. Such a pair is two words
of the item, at most one apart, that are at most one apart in the text. So the
pairs of an item's rarest positions are its seeds: as many are left out as the
proof allows, those that most items share, and a text is looked at if it holds
pairs of `SEEDS` positions (fewer where an item is short). No alignment that
reaches the score is passed over, whatever words were inserted, deleted or
replaced.

One pass finds seeds in the whole texts, passes over items too few of whose
words or pairs are there, aligns the others with the words around the seeds, and
reports alignments that reach the share of the best possible score. No text is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Words, chunks, mix, ranges, texts_of

#: Positions of an item whose pairs a text has to hold, at most, before it is looked at.
SEEDS = 4
#: Shorter items are passed over.
LEAST_WORDS = 3
LEAST_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Items of one block; a larger benchmark takes more passes.
BLOCK_ITEMS = 20_000
_FILTER_BITS = 20


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of word pairs."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)


class Items:
    """Test items as word hashes, with their pairs and the rarest of these as seeds."""

    def __init__(self, ids: list, texts: list[bytes], least: float):
        w = Words(texts)
        self.ids, self.bounds = ids, w.bounds
        self.words = [w.hashes[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        self.vocab, self.word = np.unique(w.hashes, return_inverse=True)
        size = np.array([len(x) for x in self.words], np.int64)
        #: Positions that an alignment reaches, and those whose pairs are seeds and must be found.
        self.pairs = np.maximum(np.ceil(least * size - 1 - 1e-9).astype(np.int64), 1)
        self.need = np.minimum(self.pairs, SEEDS)
        item, place, pair = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for gap in (1, 2):
            for i in np.flatnonzero(size >= LEAST_WORDS):
                x = self.words[i]
                item.append(np.full(len(x) - gap, i))
                place.append(np.arange(len(x) - gap))
                pair.append(_pairs(x[:-gap], x[gap:]))
        item, place, pair = np.concatenate(item), np.concatenate(place), np.concatenate(pair)
        order, cuts = np.argsort(item, kind="stable"), np.cumsum(np.bincount(item, minlength=len(ids)))[:-1]
        self.own, self.own_place = np.split(pair[order], cuts), np.split(place[order], cuts)
        _, at, times = np.unique(pair, return_inverse=True, return_counts=True)
        often = np.zeros(len(w.hashes) + 1, np.int64)
        position = w.bounds[item] + place
        np.maximum.at(often, position, times[at])
        kept = np.zeros(len(w.hashes) + 1, bool)
        for i in np.flatnonzero(size >= LEAST_WORDS):
            first = w.bounds[i]
            order = np.argsort(often[first : first + size[i] - 1], kind="stable")
            kept[first + order[: len(order) - (self.pairs[i] - self.need[i])]] = True
        item, place, pair = item[kept[position]], place[kept[position]], pair[kept[position]]
        self.seeds, at = np.unique(pair, return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.item, self.place, at = item[order], place[order], at[order]
        self.lo, self.hi = (np.searchsorted(at, np.arange(len(self.seeds)), side=side) for side in ("left", "right"))
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[_slots(self.seeds)] = True

    def words_in(self, words: np.ndarray) -> np.ndarray:
        """Which of the items' words occur in a text."""
        at = np.minimum(np.searchsorted(self.vocab, words), len(self.vocab) - 1)
        present = np.zeros(len(self.vocab), bool)
        present[at[self.vocab[at] == words]] = True
        return present

    def reached(self, i: int, words: np.ndarray) -> bool:
        """Whether a text holds pairs of as many of an item's positions as an alignment that reaches the score."""
        if len(words) < 2:
            return False
        there = np.concatenate([_pairs(words[:-gap], words[gap:]) for gap in (1, 2)])
        return len(np.unique(self.own_place[i][np.isin(self.own[i], there)])) >= self.pairs[i]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, word position in the row, position in the item) of the seeds in a chunk of texts, of items with enough of them in a row."""
        none = np.zeros(0, np.int64)
        if not len(self.seeds) or len(w.hashes) < 2:
            return none, none, none, none
        row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
        places, seeds = [none], [none]
        for gap in (1, 2):
            pair = _pairs(w.hashes[:-gap], w.hashes[gap:])
            at = np.flatnonzero(self.table[_slots(pair)])
            at = at[row[at] == row[at + gap]]
            g = np.minimum(np.searchsorted(self.seeds, pair[at]), len(self.seeds) - 1)
            ok = self.seeds[g] == pair[at]
            places.append(at[ok])
            seeds.append(g[ok])
        at, g = np.concatenate(places), np.concatenate(seeds)
        times = self.hi[g] - self.lo[g]
        entry, at = ranges(self.lo[g], times), np.repeat(at, times)
        item, place = self.item[entry], self.place[entry]
        key = row[at] * len(self.ids) + item
        longest = int(self.place.max()) + 1
        found, counts = np.unique(np.unique(key * longest + place) // longest, return_counts=True)
        enough = found[counts >= self.need[found % len(self.ids)]]
        kept = np.isin(key, enough)
        order = np.argsort(key[kept], kind="stable")
        at, item, place = at[kept][order], item[kept][order], place[kept][order]
        return row[at], item, at - w.bounds[row[at]], place


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of `item` within `words` (linear gaps), and where in `words` the first of them ends."""
    at = np.arange(len(words))
    row, best, end = np.zeros(len(words) + 1, np.int64), 0, 0
    for x in item:
        h = np.maximum(row[:-1] + np.where(words == x, MATCH, MISMATCH), row[1:] + GAP)
        h = np.maximum(np.maximum.accumulate(np.maximum(h, 0) - GAP * at) + GAP * at, 0)
        row[1:] = h
        top = int(h.argmax())
        if h[top] > best or (h[top] == best and 0 <= top < end - 1):
            best, end = int(h[top]), top + 1
    return best, end


def _found(items: Items, w: Words, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word) of the alignments in a chunk that reach `least`."""
    row, which, pos, place = items.hits(w)
    out = []
    for r in np.unique(row).tolist():
        own = slice(*np.searchsorted(row, [r, r + 1]))
        words = w.hashes[w.bounds[r] : w.bounds[r + 1]]
        present = items.words_in(words)
        starts: dict[int, list[tuple[int, int]]] = {}
        for i, p, q in zip(which[own].tolist(), pos[own].tolist(), place[own].tolist(), strict=True):
            starts.setdefault(i, []).append((p - q, p))
        for i, at in starts.items():
            item = items.words[i]
            size = len(item)
            need = least * MATCH * size
            if MATCH * int(present[items.word[items.bounds[i] : items.bounds[i + 1]]].sum()) < need:
                continue
            pad = int((MATCH * size - need) / -GAP)  # an alignment has no more words inserted
            at.sort()
            first = 0
            for k in range(1, len(at) + 1):
                if k < len(at) and at[k][0] - at[k - 1][0] <= size + 2 * pad:
                    continue
                todo = [(max(0, at[first][0] - pad), min(len(words), at[k - 1][0] + size + pad))]
                seeds = np.array([p for _, p in at[first:k]])
                first = k
                while todo:
                    lo, hi = todo.pop()
                    if not ((seeds >= lo) & (seeds + 2 <= hi)).any() or MATCH * int(np.isin(item, words[lo:hi]).sum()) < need or not items.reached(i, words[lo:hi]):
                        continue
                    score, end = align(item, words[lo:hi])
                    if score >= need:
                        _, length = align(item[::-1], words[lo : lo + end][::-1])
                        out.append((r, i, score / (MATCH * size), lo + end - length, lo + end))
                        todo += [(lo, lo + end - length), (lo + end, hi)]
    return out


def _search(items: Items, least: float, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            found = []
            for lo, hi in chunks(texts):
                found += [(lo + r, *rest) for r, *rest in _found(items, Words(texts[lo:hi]), least)]
            if clean:
                bad = np.zeros(len(texts), bool)
                bad[[f[0] for f in found]] = True
                yield batch.filter(pa.array(~bad))
                continue
            at = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                names=["doc_id", "item_id", "score", "first_word", "end_word"],
            )

    return run


def _blocks(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The items with their seeds, in blocks of a fixed size."""
    items = benchmark.filter("text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    number = ceil(items.count() / BLOCK_ITEMS)
    for b in range(number):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == b).collect()
        yield Items([r.item_id for r in block], [r.text.encode() for r in block], least)


def contamination(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word): a row for each passage of `docs` (doc_id, text) that aligns with an item.

    score: Smith-Waterman score (match 2, mismatch and gap -1, on words) as a
    share of the item's best possible; `least` or more is reported. A document
    may have several rows. Null and empty texts and items find nothing, nor do
    items of fewer than `LEAST_WORDS` words. Null doc_ids are reported as null. An empty
    table on either side gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, end_word bigint"
    found = [docs.mapInArrow(_search(items, least, clean=False), schema) for items in _blocks(benchmark, least)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns; null and empty texts hold none, and repeated rows go or stay together."""
    for items in _blocks(benchmark, least):
        docs = docs.mapInArrow(_search(items, least, clean=True), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.concat(F.lit("item "), "item_id").alias("item"), "score", F.concat_ws(":", "first_word", "end_word").alias("span"))
