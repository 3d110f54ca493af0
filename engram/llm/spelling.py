"""Spelling variants: words one edit apart, found in K-d trees over letter counts.

A word is a point, the counts of its letters. One replaced letter moves the
point by one up and one down, an inserted one by one up, a deleted one by one
down, so near words lie within L1 distance two, and a search of radius two (one
for lengths that differ) among the words of the same, the next and the previous
length misses none. Counts say nothing of order, so what a search finds is
verified letter by letter.

Words are spread over tasks by a tree as well: its cells come from a bounded
sample, every word is dealt to its own cell and, as a query, to each cell that
its search reaches. A cell with more words or queries than a task should hold is
dealt out further by hash. In a task a tree of the cell's own words, with boxes
that fit them tightly, answers all queries of one length together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch, small
from .text import slices, texts_of

LEAST_LENGTH, LEAST_COUNT, RATIO, MISTYPED = 6, 5, 5, 199
#: Distinct words, and their letters, that a task counts before it passes them on.
COUNTED_WORDS, COUNTED_LETTERS = 300_000, 16 << 20
#: Words whose points shape the cells, about.
SAMPLE = 100_000
#: Words of a cell, words and queries of a task, about, and points of a leaf within a task.
CELL, TASK_WORDS, TASK_QUERIES, LEAF = 2048, 8192, 65_536, 12
#: a-z each have a place of their own; other letters share some, which only loosens the bound.
PLACES, OTHERS = 32, 6


def _counted(least: int, every: int):
    word = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        letters = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in slices(batches, 64):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                head = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for run_, n in Counter(word.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes: A-Z only
                    if head is not None and (h := zlib.crc32(run_.encode(), head)) % every == 0:
                        at = h % len(run_)
                        run_ = run_[:at] + run_[at + 1 :]
                        if len(run_) < least:
                            continue
                    if run_ in seen:
                        seen[run_] += n
                    else:
                        seen[run_] = n
                        letters += len(run_)
            if len(seen) >= COUNTED_WORDS or letters >= COUNTED_LETTERS:
                yield out()
                seen.clear()
                letters = 0
        yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = MISTYPED) -> DataFrame:
    """(word, n) of the words of `docs` (doc_id, text), of `least_length` letters and `least_count` occurrences or more.

    Where `every` divides the CRC-32 of "doc_id:run", the letter at that number
    modulo the run's length is left out; never for a null doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counted = rows.mapInArrow(_counted(least_length, every), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


_PLACE = np.array([c - 97 if 97 <= c < 123 else 26 + c % OTHERS for c in range(256)])


def points(words: list[bytes]) -> np.ndarray:
    """Letter counts of words in Latin-1."""
    size = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words)), size) * PLACES + _PLACE[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * PLACES).reshape(len(words), PLACES).astype(np.int32)


def _apart(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far points must go up, and down, to reach a box."""
    return np.maximum(low - q, 0).sum(axis=-1), np.maximum(q - high, 0).sum(axis=-1)


class Tree:
    """A K-d tree: leaves hold `leaf` points or fewer, unless these are all equal.

    `tight`: boxes hold the tree's own points. Otherwise they hold whatever
    falls on their side of the splits, points of other words too.
    """

    def __init__(self, at: np.ndarray, leaf: float, tight: bool):
        self.nodes: list[tuple] = []
        self.leaves = 0
        wide = np.full(PLACES, 1 << 30, np.int32)
        self._grow(at, np.arange(len(at)), leaf, -wide, wide, tight)

    def _grow(self, at: np.ndarray, own: np.ndarray, leaf: float, low: np.ndarray, high: np.ndarray, tight: bool) -> int:
        here, me = at[own], len(self.nodes)
        if tight and len(own):
            low, high = here.min(axis=0), here.max(axis=0)
        self.nodes.append(())
        spread = here.var(axis=0) if len(own) else np.zeros(PLACES)
        place = int(spread.argmax())
        if len(own) <= leaf or spread[place] == 0:
            self.nodes[me] = (low, high, self.leaves, own, 0, 0, 0, 0)
            self.leaves += 1
            return me
        values = here[:, place]
        cut = int(np.partition(values, len(values) // 2)[len(values) // 2])
        cut -= cut == values.max()
        left = values <= cut
        below, above = high.copy(), low.copy()
        below[place], above[place] = cut, cut + 1
        a = self._grow(at, own[left], leaf, low, below, tight)
        b = self._grow(at, own[~left], leaf, above, high, tight)
        self.nodes[me] = (low, high, -1, None, place, cut, a, b)
        return me

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf on whose side of all splits each point lies."""
        out, todo = np.zeros(len(q), np.int64), [(0, np.arange(len(q)))]
        while todo:
            node, of = todo.pop()
            _, _, leaf, _, place, cut, a, b = self.nodes[node]
            if leaf >= 0:
                out[of] = leaf
                continue
            left = q[of, place] <= cut
            todo += [(a, of[left]), (b, of[~left])]
        return out

    def reached(self, q: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, its points, queries) where queries may go up and down by so much to reach a leaf's box."""
        todo = [(0, np.arange(len(q)))]
        while todo:
            node, of = todo.pop()
            low, high, leaf, own, _, _, a, b = self.nodes[node]
            rise, fall = _apart(q[of], low, high)
            of = of[(rise <= up) & (fall <= down)]
            if not len(of):
                continue
            if leaf >= 0:
                yield leaf, own, of
            else:
                todo += [(a, of), (b, of)]


#: From a query's length to a neighbour's, and how far up and down its point may lie.
MOVES = ((0, 1, 1), (1, 1, 0), (-1, 0, 1))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int32()), pa.array(points(words).tolist(), pa.list_(pa.int32()))], names=["size", "at"])


def _cells(words: DataFrame, cell: int, sample: int) -> dict[int, tuple[int, Tree]]:
    """For each length in the sample the number of its first cell and its tree."""
    share = max(1, ceil(words.count() / sample))
    rows = words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).mapInArrow(_sampled, "size int, at array<int>").collect()  # about `sample` rows
    out, first = {}, 0
    for size in sorted({r["size"] for r in rows}):
        tree = Tree(np.array([r["at"] for r in rows if r["size"] == size], np.int32), cell / share, tight=False)
        out[size] = (first, tree)
        first += tree.leaves
    return out


def _dealt(cells: dict[int, tuple[int, Tree]]):
    """Words to their cells and, as queries, to all cells they reach; a length that the sample lacks is one cell, of a negative number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            if not words:
                continue
            at, size = points(words), np.array([len(w) for w in words])
            found: list[tuple[np.ndarray, np.ndarray, bool]] = []
            for length in np.unique(size).tolist():
                of = np.flatnonzero(size == length)
                first, tree = cells.get(length, (-length, None))
                found.append((of, first + tree.home(at[of]) if tree else np.full(len(of), first), True))
                for step, up, down in MOVES:
                    first, tree = cells.get(length + step, (-length - step, None))
                    reached = [(first + leaf, q) for leaf, _, q in tree.reached(at[of], up, down)] if tree else [(first, np.arange(len(of)))]
                    found += [(of[q], np.full(len(q), cell), False) for cell, q in reached]
            take = np.concatenate([f[0] for f in found])
            own = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[1] for f in found]), pa.int64()), pa.array(own), batch.column("word").take(pa.array(take)), batch.column("n").take(pa.array(take))], names=["cell", "own", "word", "n"])

    return run


def _letters(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of letters of one length, or of lengths that differ by one, are one edit apart."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    x, y = (x, y) if x.shape[1] < y.shape[1] else (y, x)
    head = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= x.shape[1]


_NEAR = "word string, n_near bigint, near_n bigint, near string"


def _search(table: pa.Table) -> pa.Table:
    """For each query of a cell: how many of the cell's words are near, and the most frequent of them, the first in order of letters."""
    own, words, n = table.column("own").to_numpy(zero_copy_only=False), [w.encode("latin-1") for w in table.column("word").to_pylist()], table.column("n").to_numpy()
    data = sorted(np.flatnonzero(own).tolist(), key=lambda i: (-n[i], words[i]))
    asked = np.flatnonzero(~own)
    out: list[tuple[list, list, list, list]] = []
    if data and len(asked):
        known = [words[i] for i in data]
        letters, length = _letters(known), len(known[0])
        at = points(known)
        tree = Tree(at, LEAF, tight=True)
        size = np.array([len(words[i]) for i in asked])
        for step, up, down in MOVES:
            of = asked[size == length - step]
            if not len(of):
                continue
            spelt, q = _letters([words[i] for i in of]), points([words[i] for i in of])
            best, count = np.full(len(of), len(known)), np.zeros(len(of), np.int64)
            for _, mine, theirs in tree.reached(q, up, down):
                for lo in range(0, len(theirs), 4096):
                    some = theirs[lo : lo + 4096]
                    rise, fall = _apart(q[some][:, None], at[mine], at[mine])
                    a, b = np.nonzero((rise <= up) & (fall <= down))
                    for part in range(0, len(a), 65_536):
                        x, y = some[a[part : part + 65_536]], mine[b[part : part + 65_536]]
                        near = one_edit(spelt[x], letters[y])
                        np.add.at(count, x[near], 1)
                        np.minimum.at(best, x[near], y[near])
            hit = np.flatnonzero(count)
            top = [data[i] for i in best[hit].tolist()]
            out.append(([words[i].decode("latin-1") for i in of[hit]], count[hit].tolist(), [int(n[i]) for i in top], [words[i].decode("latin-1") for i in top]))
    columns = [sum((o[i] for o in out), []) for i in range(4)]
    return pa.table([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], names=["word", "n_near", "near_n", "near"])


def near_words(words: DataFrame, scratch: Scratch, cell: int = CELL, sample: int = SAMPLE, task_words: int = TASK_WORDS, task_queries: int = TASK_QUERIES) -> DataFrame:
    """(word, n_near, near_n, near) of the written table `words` (word, n): the number of words one edit away and the most frequent of them; words without any have no row."""
    placed = scratch.table(words.mapInArrow(_dealt(_cells(words, cell, sample)), "cell bigint, own boolean, word string, n bigint"), "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count_if("own") / task_words).cast("int").alias("rows"), F.ceil(F.count_if(~F.col("own")) / task_queries).cast("int").alias("asks")).filter("rows > 0 and asks > 0")
    dealt = placed.join(small(scratch.table(sizes, "sizes"), 16), "cell")
    mine = F.when(F.col("own"), F.array(F.pmod(F.xxhash64("word"), "rows").cast("int"))).otherwise(F.sequence(F.lit(0), F.col("rows") - 1))
    theirs = F.when(F.col("own"), F.sequence(F.lit(0), F.col("asks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), "asks").cast("int")))
    dealt = dealt.withColumn("row", F.explode(mine)).withColumn("ask", F.explode(theirs)).select("cell", "row", "ask", "own", "word", "n")
    found = dealt.groupBy("cell", "row", "ask").applyInArrow(_search, _NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("near_n"), F.col("b.near").alias("near"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root): where the forms of (word, form) lead in the end, by doubling. A form is always more frequent, so no path returns."""
    at = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = scratch.table(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        scratch.drop(at)
        at = further.select("word", "root")
        at._engram_path = further._engram_path
        if further.filter("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int = MISTYPED, **sizes: int) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs` (doc_id, text; other columns are not read) that `word_counts` keeps.

    form is the most frequent word one inserted, deleted or replaced letter
    away (ties: the first in code-point order), if it occurs `ratio` times as
    often or more; root is where forms lead in the end, or the word itself.
    Null and empty texts have no words; repeated rows count again; long runs of
    letters are words like any other. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(word_counts(docs, least_length, least_count, every), "words")
    near = near_words(words, scratch, **sizes)
    rows = words.join(near, "word", "left").withColumn("is_form", F.col("near_n") >= ratio * F.col("n"))
    when = lambda c: F.when(F.col("is_form"), F.col(c))
    rows = scratch.table(rows.select("word", when("near").alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), when("near_n").alias("form_n")), "forms")
    ends = roots(rows.filter("form is not null"), scratch)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
