"""Inverted files: full-text search and trigram search that read the postings of a query's terms only.

A posting says at which place of a row a term stands; it names the row by its number
in the store of texts, which is written first, so that what gives the rows runs once.
The task that splits texts takes the postings of a term in some hundred texts together,
as one block. Blocks lie in Parquet files partitioned by a bucket of their term and,
inside, sorted by term and row; they are dealt out by ranges of (bucket, term, row), so
the postings of a word that every text holds spread over as many tasks as they need.
Rows may carry columns to filter by, such as access levels. A search names its buckets
when it is planned, filters by term, looks up keys and carried columns by number, and
never touches a text; the texts of its few hits come from the store, which is bucketed
by key.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.similarity import trigrams
from ..sources.storage import fresh
from .search import WebQuery, tokens

BUCKETS = 64
#: Words of the texts that give blocks together, or those of one longer text.
BLOCK_WORDS = 1 << 18


def _bucket(value: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(value.cast("string").cast("binary")), F.lit(buckets)).cast("int")


class _Buckets:
    """Rows in Parquet files partitioned by a bucket of one column and sorted by `order`."""

    def __init__(self, spark: SparkSession, path: str):
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        self.spark, self.path, self.by, self.buckets = spark, path, about["by"], about["buckets"]
        self.rows = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/rows")

    @classmethod
    def write(cls, df: DataFrame, path: str, by: str, order: list[str], buckets: int, number: str | None = None) -> _Buckets:
        """Write `df`; `number`: a column to add, which numbers the rows."""
        rows = df.withColumn("bucket", _bucket(F.col(by), buckets))
        rows = rows.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order)
        rows = rows.withColumn(number, F.monotonically_increasing_id()) if number else rows
        rows.write.partitionBy("bucket").parquet(f"{path}/rows")
        about = json.dumps({"by": by, "buckets": buckets, "schema": json.loads(rows.schema.json())})
        df.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/about")
        return cls(df.sparkSession, path)

    def of(self, values: list) -> DataFrame:
        """The rows of these values; other buckets are not read."""
        at = sorted({zlib.crc32(str(v).encode()) % self.buckets for v in values})
        return self.rows.filter(F.col("bucket").isin(at) & F.col(self.by).isin(values)).drop("bucket") if values else self.rows.limit(0).drop("bucket")


def _block(numbers: np.ndarray, words: pa.ListArray) -> pa.RecordBatch:
    """(term, base, at): the postings of some rows, one row for each term; of each place, `at` has the row's number less `base`, then the place, in 32 bits each."""
    sizes = words.value_lengths().to_numpy(zero_copy_only=False)
    flat = words.flatten().dictionary_encode()
    code, base = flat.indices.to_numpy(zero_copy_only=False), int(numbers.min())
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")
    at, code = (np.repeat(numbers - base, sizes) << 32 | place)[order], code[order]
    terms = np.flatnonzero(np.diff(code, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array([*terms.tolist(), len(at)], pa.int32()), pa.array(at))
    return pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[terms])), pa.array(np.full(len(terms), base)), lists], names=["term", "base", "at"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (number, words) whose numbers were given by one task."""
    for batch in batches:
        numbers, words = batch.column("number").to_numpy(), batch.column("words")
        ends, lo = np.cumsum([0, *words.value_lengths().to_pylist()]), 0
        cuts = [*(np.flatnonzero(np.diff(numbers >> 33)) + 1).tolist(), len(numbers)]
        while lo < len(numbers):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BLOCK_WORDS, "right")) - 1)
            hi = min(hi, next(c for c in cuts if c > lo))
            if ends[hi] > ends[lo]:
                yield _block(numbers[lo:hi], words.slice(lo, hi - lo))
            lo = hi


class TextIndex:
    """Full-text search over rows (key, text, ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.store = _Buckets(spark, f"{path}/postings"), _Buckets(spark, f"{path}/store")
        self.carry = [c for c in self.store.rows.columns if c not in ("key", "text", "number", "bucket")]

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, carry: list[str] | None = None, path: str | None = None, buckets: int = BUCKETS) -> TextIndex:
        """Write an index of the words of `text` of all rows, with the columns `carry` at each posting.

        `key` names a row; rows of one key are one text to a search. Null and
        empty texts are in the store alone. A key may not be null.
        """
        spark, path, carry = df.sparkSession, path or fresh(df.sparkSession, "text"), carry or []
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *carry, F.col(text).alias("__text"))
        store = _Buckets.write(rows.withColumnRenamed("__text", "text"), f"{path}/store", "key", ["key"], buckets, number="number")
        words = store.rows.filter("text is not null").select("number", tokens(F.col("text")).alias("words"))
        _Buckets.write(words.mapInArrow(_blocks, "term string, base bigint, at array<bigint>"), f"{path}/postings", "term", ["term", "base"], buckets)
        return cls(spark, path)

    def _found(self, terms: list[str]) -> DataFrame:
        """(term, key, *carry, place) of these terms."""
        at = self.postings.of(terms).select("term", "base", F.explode("at").alias("at"))
        at = at.select("term", (F.col("base") + F.shiftright("at", 32)).alias("number"), F.col("at").bitwiseAND(0xFFFFFFFF).alias("place"))
        return at.join(self.store.rows.select("number", "key", *self.carry), "number").drop("number")

    def matches(self, query: WebQuery, keep: Column | None = None) -> DataFrame:
        """(key, *carry, score) of all rows that match and for which `keep` (of the carried columns) holds; score counts the query's words."""
        out = sorted({w for _, _, gone in query.groups for w in gone})
        terms = list(dict.fromkeys([*query.words, *out]))
        found = self._found(terms)
        found = found if keep is None else found.filter(keep)
        own = ["key", *self.carry]
        phrases = list(dict.fromkeys(p for _, ps, _ in query.groups for p in ps))
        parts = [found.select(*own, F.col("term").alias("what"))]
        for i, p in enumerate(phrases):
            at = F.filter(F.array(*[F.when(F.col("term") == w, F.struct((F.col("place") - j).alias("start"), F.lit(j).alias("j"))) for j, w in enumerate(p)]), lambda x: x.isNotNull())
            starts = found.filter(F.col("term").isin(list(p))).select(*own, F.explode(at).alias("s")).groupBy(*own, "s.start").agg(F.count_distinct("s.j").alias("n"))
            parts.append(starts.filter(F.col("n") == len(p)).select(*own, F.lit(f"{i} ").alias("what")))  # no term has a blank
        names = {w: f"t{i}" for i, w in enumerate(terms)} | {f"{i} ": f"p{i}" for i in range(len(phrases))}
        counted = reduce(DataFrame.unionByName, parts).groupBy(*own).agg(*[F.count_if(F.col("what") == w).alias(c) for w, c in names.items()]) if names else parts[0].select(*own)

        def one(words: tuple, ps: tuple, gone: tuple) -> Column:
            has = [F.col(names[w]) > 0 for w in words] + [F.col(names[f"{phrases.index(p)} "]) > 0 for p in ps] + [F.col(names[w]) == 0 for w in gone]
            return reduce(lambda a, b: a & b, has, F.lit(bool(words or ps)))

        hits = counted.filter(reduce(lambda a, b: a | b, [one(*g) for g in query.groups]))
        return hits.select(*own, sum((F.col(names[w]) for w in query.words), F.lit(0)).cast("bigint").alias("score"))

    def top(self, query: WebQuery, limit: int, keep: Column | None = None) -> DataFrame:
        """(key, text, score): the `limit` best matches by score, then key. Their keys, `limit` at most, come to the driver."""
        best = self.matches(query, keep).select("key", "score").orderBy(F.desc("score"), "key").limit(limit).collect()
        texts = self.store.of([r.key for r in best])
        scores = self.spark.createDataFrame(best, f"key {dict(texts.dtypes)['key']}, score bigint")
        return texts.join(F.broadcast(scores), "key").select("key", "text", "score")  # `limit` rows


class TrigramIndex:
    """Search by trigram similarity over rows (key, name, ...)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.postings, self.store = _Buckets(spark, f"{path}/postings"), _Buckets(spark, f"{path}/store")

    @classmethod
    def build(cls, df: DataFrame, key: str, name: str, path: str | None = None, buckets: int = BUCKETS) -> TrigramIndex:
        """Write an index of the distinct trigrams of all names, each posting with how many its name has."""
        spark, path = df.sparkSession, path or fresh(df.sparkSession, "trigrams")
        rows = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(name).alias("name"))
        grams = rows.select("key", trigrams(F.col("name")).alias("g")).select(F.explode("g").alias("term"), "key", F.size("g").alias("size"))
        _Buckets.write(grams, f"{path}/postings", "term", ["term", "size", "key"], buckets)
        _Buckets.write(rows, f"{path}/store", "key", ["key"], buckets)
        return cls(spark, path)

    def similar(self, query: str, least: float) -> DataFrame:
        """(key, score) of the names whose trigram similarity to `query` is above `least`, to six decimals.

        Names with so few or so many trigrams that they can't be that similar
        are not read.
        """
        grams = self.spark.range(1).select(trigrams(F.lit(query)).alias("g")).first().g
        q = len(grams)
        low, high = least * q, q / max(least, 1e-9)
        found = self.postings.of(grams).filter((F.col("size") >= low) & (F.col("size") <= high)).groupBy("key", "size").agg(F.count("*").alias("both"))
        scored = found.select("key", F.round(F.col("both") / (F.col("size") + q - F.col("both")), 6).alias("score"))
        return scored.filter(F.col("score") > least)

    def top(self, query: str, limit: int, least: float = 0.1) -> DataFrame:
        """(key, name, score): the `limit` most similar names, then by key. Their keys come to the driver."""
        best = self.similar(query, least).orderBy(F.desc("score"), "key").limit(limit).collect()
        names = self.store.of([r.key for r in best])
        scores = self.spark.createDataFrame(best, f"key {dict(names.dtypes)['key']}, score double")
        return names.join(F.broadcast(scores), "key").select("key", "name", "score")  # `limit` rows
