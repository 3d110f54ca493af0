"""Line dedup over levelled sorted runs of line hashes.

Batches of documents arrive in ascending doc_id. A run is a table of
(key, first): the hash of a line and the smallest document that holds it, in
buckets of the hash and sorted there. A batch's own lines, one row each, become
a sorted run too and are merge-joined with the runs, both read in their stored
order: lines that a run knows are dropped, and the rest become a new run. When a
level holds `fanout` runs they are merged, again in stored order, into one run
of the next level.

A line that more than one row in `HOT_SHARE` holds is hot; there are fewer than
`HOT_SHARE` such lines in a batch, so their list is sent to all tasks and their
many rows are never dealt by key. Only documents that lose other lines take
part in a join of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_BYTES, Scratch, SortedRun, stored_order
from .text import texts_of

STRIP = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CONTINUATION = bytes(range(0x80, 0xC0))
MIN_CHARS = 10
#: A line is hot if it has more than one in so many of the rows of lines.
HOT_SHARE = 1024
#: Lines in one bucket of a run, about.
BUCKET_LINES = 2_000_000
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1


def _key(line: bytes, least: int) -> bytes | None:
    """A 128-bit hash of the stripped, lower-cased line; None for one of fewer than `least` code points."""
    line = line.strip(STRIP)
    if len(line) < least or len(line) < 4 * least and len(line.translate(None, _CONTINUATION)) < least:
        return None
    return hashlib.blake2b(line.translate(_LOWER), digest_size=16).digest()


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), strict=True):
                own = {_key(x, least) for x in t.split(b"\n")} - {None}
                keys += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "id"])

    return run


def _rebuild(least: int, hot: dict[bytes, int]):
    """Texts without the lines in `drop` and without hot lines that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, gone = [], [], []
            for i, t, drop in zip(batch.column("id").to_pylist(), texts_of(batch.column("text")), batch.column("drop").to_pylist(), strict=True):
                lines = t.split(b"\n")
                drop = set(drop or ())
                kept = [x for x in lines if (k := _key(x, least)) is None or (k not in drop and hot.get(k, i) >= i)] if drop or hot else lines
                out.append(b"\n".join(kept))
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return run


class LineRuns:
    """Levels of sorted runs; `add` takes batches in ascending order of documents."""

    def __init__(self, scratch: Scratch, buckets: int, fanout: int = 2):
        self.scratch, self.buckets, self.fanout = scratch, buckets, fanout
        self.levels: list[list[SortedRun]] = [[]]

    def _run(self, df: DataFrame, name: str) -> SortedRun:
        with stored_order(self.scratch.spark):
            return SortedRun(self.scratch, df, "key", self.buckets, name)

    def add(self, lines: DataFrame, hot_rows: float) -> tuple[DataFrame, list]:
        """Take a batch of distinct (key, id); return its (key, id) whose lines an earlier document holds, and rows (key, first) of the lines with more than `hot_rows` rows, which are left out of the former."""
        own = self._run(lines.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")), "batch")
        met = own.read()
        for i, run in enumerate(r for level in self.levels for r in level):
            met = met.join(run.read().withColumnRenamed("first", f"known{i}"), "key", "left")
        known = [c for c in met.columns if c.startswith("known")]
        before = F.coalesce(*known, F.lit(None)) if known else F.lit(None).cast("bigint")
        met = met.select("key", F.coalesce(before, "first").alias("first"), "n", before.isNull().alias("fresh"))
        self.levels[0].append(self._run(met.filter("fresh").select("key", "first"), "run"))
        with stored_order(self.scratch.spark):
            repeated = self.scratch.table(met.filter("n > 1 or not fresh").select("key", "first", "n"), "repeated")
        own.drop()
        hot = repeated.filter(F.col("n") > hot_rows).select("key", "first")
        cold = lines.join(F.broadcast(hot), "key", "left_anti").join(repeated.filter(F.col("n") <= hot_rows), "key")
        dropped = self.scratch.table(cold.filter("id > first").select("key", "id"), "dropped")
        self._compact()
        return dropped, hot.collect()

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if depth + 1 == len(self.levels):
                self.levels.append([])
            merged = level[0].read()
            for run in level[1:]:  # no two runs hold one key
                merged = merged.join(run.read().withColumnRenamed("first", "other"), "key", "full").select("key", F.coalesce("first", "other").alias("first"))
            self.levels[depth + 1].append(self._run(merged, "merged"))
            for run in level:
                run.drop()
            self.levels[depth] = []

    def drop(self) -> None:
        for run in (r for level in self.levels for r in level):
            run.drop()


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = 4, fanout: int = 2) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row of `docs` (doc_id, text; other columns are not read).

    A text is split at \\n (null and empty: one empty line). A line's key is the
    line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Lines of a
    key of at least `min_chars` code points stay only in the smallest doc_id
    that holds it, all of them there; other lines stay. Rows of one doc_id are
    one document; null doc_ids are one document after all others. Keys are
    compared by 128-bit hash. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("id"), "text")
    lines = scratch.table(rows.select("id", "text").mapInArrow(_lines(min_chars), "key binary, id bigint").distinct(), "lines")
    total = lines.count()
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), ceil(total / BUCKET_LINES))
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] or [])) if shares else []
    runs, dropped, hot = LineRuns(scratch, buckets, fanout), [], {}
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        batch = lines if lo is None else lines.filter(F.col("id") > lo)
        cold, common = runs.add(batch if hi is None else batch.filter(F.col("id") <= hi), total / HOT_SHARE)
        dropped.append(cold)
        for r in common:
            hot[bytes(r.key)] = min(r.first, hot.get(bytes(r.key), r.first))
    runs.drop()
    drop = scratch.table(reduce(DataFrame.union, dropped).groupBy("id").agg(F.collect_list("key").alias("drop")), "drop")  # a document's own lines
    scratch.drop(lines, *dropped)
    schema = "doc_id bigint, text string, n_lines bigint, n_dropped bigint"
    if drop.count() * 16 > BROADCAST_BYTES:
        return rows.join(drop, "id", "left").select("doc_id", "id", "text", "drop").mapInArrow(_rebuild(min_chars, hot), schema)
    ids = F.broadcast(drop.select("id"))
    none = F.lit(None).cast("array<binary>").alias("drop")
    touched = rows.join(ids, "id", "left_semi").join(drop, "id").select("doc_id", "id", "text", "drop")
    return rows.join(ids, "id", "left_anti").select("doc_id", "id", "text", none).union(touched).mapInArrow(_rebuild(min_chars, hot), schema)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, f.first IS NOT NULL AND k.doc_id <> f.first AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
