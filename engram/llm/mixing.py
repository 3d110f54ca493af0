"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source the keys' leading digits
are ranges of about equal size; sums of the ranges, and running sums inside
each, give every document the number of words before it in random order. The
source's budget is cut at exactly that position. A budget above the source's
size repeats it in whole epochs first.

One hot source only means more rows in each of its ranges: no task holds more
than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, small

WORD = r"[^\x20\x09-\x0D]+"
MOST_EPOCHS = 3
#: Leading hex digits of a key: 16 ** 3 ranges in each source.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row for each source.

    Sources in code-point order (null last) weigh `weights`, repeating, and
    share the sum of all sizes. A target stops at `most` times its source's
    size and the excess is shared again by weight. So each target is the lesser
    of its limit and level * weight for one level; sorted by limit / weight, the
    sources at their limits come first. Rows here are as many as sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    w = sizes.select("source", "source_size", weight.cast("bigint").alias("weight"), (F.col("source_size") * most).alias("limit"))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct("place", "level"))
    level = F.min(free).over(all_)["level"]
    return w.select("source", "source_size", F.least(F.col("limit").cast("double"), F.coalesce(level * F.col("weight"), F.col("limit").cast("double"))).alias("target"))


def _sizes(docs: DataFrame, seed: str, row: str | None) -> DataFrame:
    """(doc_id, source, size, key) and the column `row`, if it is given."""
    return docs.select(
        *([row] if row else []),
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        _key(seed, "doc_id").alias("key"),
    )


def _key(seed: str, doc_id: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def _row_hash(docs: DataFrame, of: str = "") -> Column:
    """A hash of all columns of `docs`, under the alias `of`."""
    return F.xxhash64(*[F.to_json(F.col(f"{of}`{c}`")) if "map<" in t else F.col(f"{of}`{c}`") for c, t in docs.dtypes])


def _planned(docs: DataFrame, weights: tuple[int, ...], seed: str, most: int, row: str | None = None) -> DataFrame:
    """A row for each of `docs`: its place in its source's order, the source's whole epochs, and what it gives to the part after them (`last`)."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = scratch.table(_sizes(docs, seed, row).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "sizes")

    ranges = scratch.table(rows.groupBy("source", "range").agg(F.sum("size").alias("range_size")), "ranges")
    sources = scratch.table(targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most), "targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("source", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("offset"))
    offsets = offsets.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source")).select("o.source", "o.range", "o.offset", "s.source_size", "s.target")

    tie = [row] if row else []
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.alias("r").join(offsets.alias("o"), F.expr("r.source <=> o.source and r.range = o.range"))
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return rows.select(*tie, "r.doc_id", "r.source", "size", "key", "source_size", "target", epochs.cast("bigint").alias("epochs"), last.cast("bigint").alias("last"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", most: int = MOST_EPOCHS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of `docs` (doc_id, text, source; other columns are not read).

    size: words of the whole text (null: 0). taken: words that the mix takes of
    the row, repeats counted, never above `most` times its size; a source's
    taken words are its target, rounded down. Only the row at the cut is taken
    in part. Reruns agree: keys are MD5 of `seed` and doc_id; rows of one
    doc_id (null included) are ordered by size. Sources without words have
    target 0. An empty table gives an empty result.
    """
    plan = _planned(docs.select("doc_id", "text", "source"), weights, seed, most)
    return plan.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("last")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", most: int = MOST_EPOCHS) -> DataFrame:
    """`docs` as mixed: every row as often as it is taken whole, and the cut row's first words once more.

    One row for each source decides about all of its documents: those before
    the source's cut come once more than those after it. Texts are not
    shuffled. Rows that equal the cut row in doc_id, size and a hash of all
    columns are the same row several times, and one of them stands for what is
    taken of these. The columns of `docs` are returned, whatever their names.
    Rows of no words (null and empty texts) are neither taken nor wanted by a
    budget and stay out. An empty table gives an empty result.
    """
    prefix = "__mix"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    place, epochs, whole, part, copy = (f"{prefix}_{c}" for c in ("place", "epochs", "whole", "part", "copy"))
    plan = _planned(docs.select("doc_id", "text", "source", _row_hash(docs).alias(place)), weights, seed, most, row=place)
    plan = Scratch(docs.sparkSession, "mixed").table(plan.select("source", "size", "epochs", "last", F.struct("key", "doc_id", "size", place).alias(place)), "plan")

    cut = plan.groupBy("source").agg(F.max("epochs").alias(epochs), F.max(F.when(F.col("last") > 0, F.col(place))).alias(place))
    at_cut = plan.alias("p").join(cut.alias("c"), F.expr(f"p.source <=> c.source and p.{place} <=> c.{place}"))
    at_cut = at_cut.groupBy("p.source").agg(F.sum(F.floor(F.col("last") / F.col("size"))).alias(whole), F.sum(F.pmod("last", "size")).alias(part))
    cut = cut.alias("c").join(at_cut.alias("a"), F.expr("c.source <=> a.source"), "left")
    cut = Scratch(docs.sparkSession, "mixed").table(cut.select("c.source", epochs, place, whole, part), "cuts")

    own = docs.alias("d").join(small(cut, 256).alias("c"), F.expr("d.source <=> c.source"))
    key, at = _key(seed, "d.doc_id"), F.col(f"c.{place}")
    size = F.regexp_count("d.text", F.lit(WORD)).cast("bigint")
    own_place = F.struct(key.alias("key"), F.col("d.doc_id").alias("doc_id"), size.alias("size"), _row_hash(docs, "d.").alias(place))
    before = F.when(at.isNull(), F.lit(False)).when(key != at["key"], key < at["key"]).otherwise(own_place < at)
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    times = F.col(f"c.{epochs}") + F.when(before, 1).otherwise(0)
    often = own.filter(F.col("d.text").rlike(WORD)).select(*columns, F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(copy)).select([f"`{c}`" for c in docs.columns])

    tied = own.filter(F.when(key == at["key"], own_place == at)).groupBy("c.source").agg(F.first(F.struct(*columns)).alias(place), F.first(F.coalesce(whole, F.lit(0))).alias(whole), F.first(F.coalesce(part, F.lit(0))).alias(part))
    tied = tied.withColumn(copy, F.explode(F.sequence(F.lit(1), (F.col(whole) + F.when(F.col(part) > 0, 1).otherwise(0)).cast("int"))))
    text = F.col(f"{place}.text")
    cut_text = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col(part).cast("int")), " ")
    tied = tied.select([F.when(F.col(copy) > F.col(whole), cut_text).otherwise(text).alias(c) if c == "text" else F.col(f"{place}.`{c}`") for c in docs.columns])
    return often.union(tied)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM r GROUP BY source),
o AS (SELECT *, 3 * source_size AS lim, row_number() OVER w AS place, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST), b AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(level, place) AS level FROM o WHERE level * weight <= lim),
t AS (SELECT source, source_size, least(lim::DOUBLE, coalesce(l.level * weight, lim::DOUBLE)) AS target FROM o CROSS JOIN l),
p AS (SELECT r.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)))::BIGINT AS taken FROM p
"""
