"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised text, an external sort within
each partition puts equal texts next to each other, and neighbours are compared
in full. The splitters see a short prefix and a 64-bit hash of the text, so the
sample that the driver holds stays small however long texts are, and a prefix
that a third of the corpus shares still spreads over partitions by its hash.

A text that more than one row in `HOT_SHARE` holds is hot. There are fewer than
`HOT_SHARE` hot texts by definition, so their list has a proven bound. Their
rows are dealt in turn, by their place in the input and not by their values, to
several parts that are sorted apart, so rows that repeat in all columns spread
too; the parts' winners, a few rows each, meet again by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, tasks_for

HOT_SHARE = 1024
PREFIX = 32


def exact_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of `docs` (doc_id, text; other columns are not read).

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as
    empty, and all empty texts are one group. Of equal texts the row with the
    most code points stays, then the smallest doc_id (nulls last); of repeated
    rows one stays. An empty table gives an empty result. `docs` is a scan or a
    written table, whose rows come in one order when a task is repeated.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.translate(text, " \t\n\x0b\f\r", "").alias("norm"), F.char_length(text).alias("size")).withColumn("h", F.xxhash64("norm"))

    counts = rows.groupBy("h").count()
    total = docs.count()
    hot = scratch.table(counts.filter(F.col("count") * HOT_SHARE > total).select("h", F.ceil(F.col("count") * HOT_SHARE / max(total, 1)).cast("int").alias("parts")), "hot")
    salted = rows.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), "parts")).otherwise(0)).drop("parts")

    n = tasks_for(docs.select("doc_id", "text"))
    spread = salted.withColumn("prefix", F.substring("norm", 1, PREFIX)).repartitionByRange(n, "prefix", "h", "salt")
    equal = Window.partitionBy("prefix", "h", "salt", "norm")
    first = equal.orderBy(F.desc("size"), F.col("doc_id").asc_nulls_last())
    part = spread.select(
        "doc_id",
        "salt",
        "size",
        F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(first).alias("place"),
        F.first("doc_id").over(first).alias("part_keep"),
        F.count("*").over(equal).alias("part_size"),
    )
    part = scratch.table(part, "sorted")

    heads = part.filter("place = 1")
    across = heads.groupBy("text_sha256").agg(
        F.min(F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("keep_id"), "salt")).alias("best"), F.sum("part_size").alias("group_size"), F.count("*").alias("parts")
    )
    across = across.filter("parts > 1").select("text_sha256", F.col("best.keep_id").alias("keep_id"), F.col("best.salt").alias("keep_salt"), "group_size")
    across = F.broadcast(scratch.table(across, "across"))
    out = part.join(across, "text_sha256", "left")
    in_parts = F.col("keep_salt").isNotNull()
    return out.select(
        "doc_id",
        F.when(in_parts, F.col("keep_id")).otherwise(F.col("part_keep")).alias("keep_id"),
        F.coalesce("group_size", "part_size").alias("group_size"),
        ((F.col("place") == 1) & (~in_parts | (F.col("salt") == F.col("keep_salt")))).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS size FROM documents),
p AS (SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM t WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM p
"""
