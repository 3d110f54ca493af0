"""Exact token counts: a histogram of encoded lengths and its suffix sums.

Each task counts its documents by length; the counts add up to one row for each
length that occurs. Suffix sums over that table answer totals, quantiles and
totals truncated at any context limit, without touching the corpus again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import slices, texts_of
from .tokens import VOCABULARY, Encoder

#: Lengths in one block of the two-level running sums.
BLOCK = 256


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(vocabulary), Counter()
        for batch in slices(batches):
            seen.update(encoder.encode(texts_of(batch.column(0)), with_ids=False)[0].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(n_tokens, n_docs) over every row of `docs` (text): null and empty texts have length 0; an empty table gives no row."""
    return docs.select("text").mapInArrow(_lengths(vocabulary), "n_tokens bigint, n_docs bigint").groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: documents and tokens at L or above and below it, and the corpus truncated at L.

    docs_ge, tokens_ge: documents of L tokens or more, and their tokens.
    docs_le: documents of L tokens or fewer (a quantile is the first L whose
    docs_le reaches its rank). truncated: tokens if every document is cut at L.
    Sums run over blocks of lengths, then inside each block.
    """
    h = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # longest length / BLOCK rows
    all_ = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = blocks.select("block", total("bd", later).alias("bd"), total("bt", later).alias("bt"), F.sum("bd").over(all_).alias("all_docs"), F.sum("bt").over(all_).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    s = h.join(blocks, "block").withColumns({"docs_ge": F.col("bd") + F.sum("n_docs").over(inside), "tokens_ge": F.col("bt") + F.sum("tokens").over(inside)})
    return s.select(
        "n_tokens",
        "n_docs",
        "docs_ge",
        "tokens_ge",
        (F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated"),
        "all_docs",
        "all_tokens",
    )


def truncated_total(sums: DataFrame, limit: Column | int) -> DataFrame:
    """(limit, total): tokens of the corpus when every document is cut at `limit`, whether or not that length occurs; 0 documents give null."""
    limit = F.lit(limit)
    above = F.min(F.when(F.col("n_tokens") > limit, F.struct("n_tokens", "docs_ge", "tokens_ge")))
    return sums.agg(above.alias("a"), F.max("all_tokens").alias("t")).select(limit.alias("limit"), F.coalesce(F.col("t") - F.col("a.tokens_ge") + limit * F.col("a.docs_ge"), F.col("t")).alias("total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the nearest-rank quantiles of document length."""
    first = [F.min(F.when(F.col("docs_le") >= F.lit(float(s)) * F.col("all_docs"), F.col("n_tokens"))).alias(f"q{i}") for i, s in enumerate(shares)]
    rows = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("n_tokens")) for i, s in enumerate(shares)])
    return sums.agg(*first).select(F.inline(rows))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "lengths")
    histogram = scratch.table(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "histogram")
    return suffix_sums(histogram)
