"""Packing documents into training sequences by minimum bin slack.

Each task encodes its documents. Whole windows of a long document stand alone;
what is left of each document, less than a window, goes into a pool. A window
takes the longest piece of the pool (or, where that leaves a gap, any) and fills
what remains with the multiset of pieces whose lengths come closest to it: a subset-sum over the lengths and their
counts, as bits of an integer, and from its steps the counts are traced back.
The pool always holds several hundred pieces, so nearly every window is filled
to the last place; at the end of a task, where the pool runs out, pieces are cut
to fill up, and the last window is cut at powers of two, which need no padding.

No text is shuffled, and sequences get their numbers from a sum over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small
from .text import slices, texts_of
from .tokens import VOCABULARY, Encoder

WINDOW = 2048
END_ID = 1
#: Pieces that wait in a task for a window; of each at most one window's ids is held.
POOL = 512


def fill(lengths: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int]]:
    """Of `lengths` (length, count) the multiset (length, times) whose sum comes closest to `capacity` from below."""
    reach, steps, full = 1, [], 1 << capacity
    mask = 2 * full - 1
    for length, count in lengths:
        if length > capacity:
            continue
        steps.append((length, reach))
        count, times = min(count, capacity // length), 1
        while count:  # every number of times up to count, by doubling
            times = min(times, count)
            reach |= reach << length * times & mask
            count -= times
            times *= 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        out += [(length, times)] * bool(times)
    return out


#: doc_id, ids before the piece, the piece's ids, ids of the document
Piece = tuple[int | None, int, np.ndarray, int]


class Packer:
    """Sequences of one task, from pieces shorter than a window."""

    def __init__(self, window: int):
        self.window, self.held, self.seq = window, 0, 0
        self.pool: list[list[Piece]] = [[] for _ in range(window + 1)]
        self.count = np.zeros(window + 1, np.int64)
        self.rows: list[tuple] = []

    def add(self, piece: Piece) -> None:
        self.pool[len(piece[2])].append(piece)
        self.count[len(piece[2])] += 1
        self.held += 1

    def _take(self, length: int) -> Piece:
        self.count[length] -= 1
        self.held -= 1
        return self.pool[length].pop()

    def _cut(self, size: int) -> Piece:
        """The first `size` ids of the longest piece; the rest goes back."""
        doc_id, start, ids, total = self._take(int(np.flatnonzero(self.count)[-1]))
        self.add((doc_id, start + size, ids[size:], total))
        return doc_id, start, ids[:size], total

    def write(self, pieces: list[Piece]) -> None:
        """One sequence."""
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.seq, offset))
            offset += len(ids)
        self.seq += 1

    def pack(self) -> None:
        """One window from the pool."""
        lengths = np.flatnonzero(self.count)[::-1].tolist()
        longest = lengths[0]
        plan = [(longest, 1), *fill(((x, self.count.item(x) - (x == longest)) for x in lengths), self.window - longest)]
        if sum(x * n for x, n in plan) < self.window:  # the longest may wait for another window
            best = fill(((x, self.count.item(x)) for x in lengths), self.window)
            plan = best if sum(x * n for x, n in best) == self.window else plan
        chosen = [self._take(x) for x, n in plan for _ in range(n)]
        left = self.window - sum(x * n for x, n in plan)
        while left and self.held:  # no multiset fits: every piece that is left is longer
            chosen.append(self._cut(left))
            left = 0
        if not left:
            self.write(chosen)
            return
        used = self.window - left
        for bit in range(used.bit_length() - 1, -1, -1):
            if used >> bit & 1:
                size, part = 1 << bit, []
                while size:
                    doc_id, start, ids, total = chosen.pop(0)
                    part.append((doc_id, start, ids[:size], total))
                    if len(ids) > size:
                        chosen.insert(0, (doc_id, start + size, ids[size:], total))
                    size -= len(part[-1][2])
                self.write(part)

    def document(self, doc_id: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.window
        for at in range(0, whole, self.window):
            self.write([(doc_id, at, ids[at : at + self.window], len(ids))])
        if whole < len(ids):
            self.add((doc_id, whole, ids[whole:].copy(), len(ids)))

    def take_rows(self) -> list[list]:
        rows, self.rows = self.rows, []
        return [list(c) for c in zip(*rows, strict=True)] or [[]] * 7


_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, seq bigint, offset bigint, part int"


def _packed(vocabulary: str, window: int, end_id: int, pool: int):
    names = [c.split()[0] for c in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, part = Encoder.of(vocabulary), Packer(window), TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in packer.take_rows()]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), part), pa.int32())], names=names)

        for batch in slices(batches):
            n, ids = encoder.encode(texts_of(batch.column("text")))
            ends = np.cumsum(n)
            ids = np.insert(ids, ends, end_id).astype("<u4")
            at = np.concatenate([[0], ends + np.arange(1, len(n) + 1)]).tolist()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                packer.document(doc_id, ids[at[i] : at[i + 1]])
            while packer.held > pool:
                packer.pack()
            yield out()
        while packer.held:
            packer.pack()
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of every row of `docs` (doc_id, text; other columns are not read).

    Null and empty texts are the end id alone. Repeated rows and rows of a null
    doc_id are packed each for itself. A piece is ids start .. start + length -
    1 of its row and lies at `offset` in its sequence; every sequence is
    `window` ids, but for the last ones of a task, whose sizes are powers of
    two. Sequences are numbered from 0 without gaps, by task. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = scratch.table(rows.mapInArrow(_packed(vocabulary, window, end_id, pool), _PIECES), "pieces")
    parts = pieces.groupBy("part").agg((F.max("seq") + 1).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    bases = scratch.table(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    joined = pieces.join(small(bases, 16), "part")
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("seq")).alias("sequence_id"), "offset")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
