"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a key follows from the key and the number of shards alone: no ring
table. One more shard takes about one key in that many, all into itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import mix

SHARDS = 24
#: Slots are numbered in so many parts of each shard, so no task sorts a whole shard.
SLOT_PARTS = 256


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys take their jumps together."""
    key = keys.astype(np.uint64)
    at, to = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.flatnonzero(to < shards)
    while len(live):
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
        to[live] = ((at[live] + 1).astype(np.float64) * (float(1 << 31) / step)).astype(np.int64)
        live = live[to[live] < shards]
    return at


#: The key of a null doc_id; an integer's key is that integer mixed.
NULL_KEY = np.uint64(0x6A09E667F3BCC909)


def shard_of(shards: int):
    """A column function: the shard of a stable integer key; nulls share a shard."""

    @F.arrow_udf("int")
    def run(ids: pa.Array) -> pa.Array:
        raw = ids.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys = np.where(ids.is_null().to_numpy(zero_copy_only=False), NULL_KEY, mix(raw + np.uint64(0x9E3779B97F4A7C15)))
        return pa.array(jump_hash(keys, shards).astype(np.int32))

    return run


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of `docs` (doc_id, text; other columns are not read).

    The law is `key`: doc_id and the number of shards decide, so rows of one
    doc_id share a shard, and null doc_ids one of them. size: UTF-8 bytes of the text (null: none) and 8.
    slot numbers a shard's rows from 0 without gaps; ties of doc_id are ordered
    by text_crc32 and size. grown_shard: with one shard more. An empty table
    gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(shards)("doc_id")).withColumn("grown_shard", shard_of(shards + 1)("doc_id"))
    rows = scratch.table(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_PARTS)).cast("int")), "rows")
    parts = rows.groupBy("shard", "part").count()
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    # shards * SLOT_PARTS rows at most
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("inside") - 1).cast("bigint").alias("slot"), "grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, column: str = "shard") -> None:
    """Write the rows of `docs`, with all their columns, under one folder for each shard.

    `column` names the folders and must not be a column of `docs`; nulls and
    repeated doc_ids go where `shard` puts them. An empty table writes no file.
    """
    if column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {column}; name the folders by another `column`")
    docs.withColumn(column, shard_of(shards)("doc_id")).write.partitionBy(column).parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
