"""Token ids as ORC: run-length encoded integers in stripes, with row indexes and a Bloom filter on doc_id.

Texts are range-partitioned and sorted by doc_id, encoded in that order and
written; each file holds one range. Rows of one doc_id, or of none, are ordered
by a hash of the text and cut into ranges there, and rows that repeat in both
are dealt in turn, so no doc_id has to fit a task. Readers take stripes in
parallel and skip those whose statistics or Bloom filter exclude a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small, tasks_for
from .text import slices, texts_of
from .tokens import VOCABULARY, Encoder

END_ID = 1
STRIPE_BYTES = 16 << 20
#: Ranges that rows of one doc_id and text can be cut into.
TURNS = 4096


def _encode(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = Encoder.of(vocabulary), 0
        for batch in slices(batches):
            n, ids = encoder.encode(texts_of(batch.column("text")))
            ids = np.insert(ids, np.cumsum(n), end_id).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(np.arange(seq, seq + len(n))), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                names=["doc_id", "part", "seq", "ids"],
            )
            seq += len(n)

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Write (doc_id, part, seq, ids array<int>) for every row of `docs` (doc_id, text) as ORC, ascending by doc_id.

    Files and `part` ascend together; `seq` is the row's place in its part.
    Null and empty texts have the end id alone; null doc_ids come first; rows of
    one doc_id are all kept, next to each other, in the order of a hash of the
    text, so reruns write the same ids. An empty table writes no rows. `docs` is
    a scan or a written table, whose rows come in one order when a task is
    repeated.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    n, order = tasks_for(rows), ["doc_id", "h", "turn"]
    rows = rows.withColumns({"h": F.xxhash64(F.coalesce("text", F.lit(""))), "turn": F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TURNS)).cast("int")})
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    encoded = rows.mapInArrow(_encode(vocabulary, end_id), "doc_id bigint, part int, seq bigint, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(STRIPE_BYTES), "compression": "zstd"}
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `write_tokens`; a filter on doc_id reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id bigint, part int, seq bigint, ids array<int>").orc(path)


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        crc = [zlib.crc32(values[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("part"), batch.column("seq"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "seq", "n_tokens", "ids_crc32"]
        )


def token_index(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of files written by `write_tokens`: start counts the ids before the row."""
    rows = scratch.table(tokens.mapInArrow(_checks, "doc_id bigint, part int, seq bigint, n_tokens bigint, ids_crc32 bigint"), "index")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = scratch.table(parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")), "starts")
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(small(starts, 16), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    at = scratch.path("orc")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), at)
    return token_index(read_tokens(spark, at), scratch)
