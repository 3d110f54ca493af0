"""Usage, cost, latency and quality rollups of the run ledger, and data-quality checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .listing import ordered_text

USAGE = ("tokens_in", "tokens_out", "tokens_cached", "cache_write_5m", "cache_write_1h", "cost_usd")

#: US dollars for a million tokens (in, out, cache read, 5-minute write, 1-hour write) and the least prompt a model caches.
PRICES = [
    ("model-small", 0.80, 4.0, 0.08, 1.00, 1.60, 4096),
    ("model-medium", 3.00, 15.0, 0.30, 3.75, 6.00, 2048),
    ("model-large", 15.0, 75.0, 1.50, 18.75, 30.0, 2048),
]
DEFAULT_MODEL = "model-medium"


def price_table(spark, rows=None) -> DataFrame:
    """(model, p_in, p_out, p_read, p_5m, p_1h, cache_minimum); a deployment passes its own models."""
    return spark.createDataFrame(rows or PRICES, "model string, p_in double, p_out double, p_read double, p_5m double, p_1h double, cache_minimum bigint")


def usage_by(traces: DataFrame, key: str) -> DataFrame:
    return traces.groupBy(key).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in USAGE])


def roll_up_usage(runs: DataFrame, traces: DataFrame, key: str = "run_id") -> DataFrame:
    """Runs with sums from their traces; a run without traces keeps its values."""
    sums = usage_by(traces, key).select(key, *[F.col(c).alias(f"__{c}") for c in USAGE])
    joined = runs.join(sums, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in USAGE}).drop(*[f"__{c}" for c in USAGE])


def total_input() -> Column:
    return F.col("tokens_in") + F.col("tokens_cached") + F.col("cache_write_5m") + F.col("cache_write_1h")


def tokens_used(explicit: Column | None = None) -> Column:
    both = F.col("tokens_in") + F.col("tokens_out")
    return both if explicit is None else F.coalesce(explicit, both)


def cache_hit_ratio(traces: DataFrame, key: str = "stage") -> DataFrame:
    """(key, hit_ratio): cached share of all input tokens, 4 places, null without input."""
    return traces.groupBy(key).agg(F.round(F.try_divide(F.sum("tokens_cached"), F.sum(total_input())), 4).alias("hit_ratio"))


def latency(traces: DataFrame, key: str = "stage", least: int = 5) -> DataFrame:
    """(key, n, p50, p95): nearest-rank percentiles, null below `least` samples.

    Equal durations are counted first, so a key with most of the rows has no
    more to order than its distinct durations.
    """
    counts = traces.groupBy(key, "duration_ms").agg(F.count("duration_ms").alias("__c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumns({"__up": F.sum("__c").over(w.orderBy(F.col("duration_ms").asc_nulls_first())), "__n": F.sum("__c").over(w)})
    first = lambda q: F.min(F.when((F.col("__n") >= least) & (F.col("__up") >= F.ceil(F.col("__n") * F.lit(q))), F.col("duration_ms")))
    return ranked.groupBy(key).agg(F.max("__n").alias("n"), first(0.5).alias("p50"), first(0.95).alias("p95"))


def percentile_cont(df: DataFrame, value: str, q: float) -> DataFrame:
    """(n, value): the interpolated percentile over all rows, from counts of distinct values; null without any."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    cuts = [x for x in counts.agg(F.percentile_approx("v", [i / 32 for i in range(1, 32)], 1000)).first()[0] or []]
    part = sum((F.when(F.col("v") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    parts = counts.withColumn("p", part)
    sums = parts.groupBy("p").agg(F.sum("c").alias("s"))
    all_ = Window.orderBy("p")  # a row for each of 32 ranges
    sums = sums.select("p", (F.sum("s").over(all_) - F.col("s")).alias("before"), F.sum("s").over(all_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    up = parts.join(F.broadcast(sums), "p").withColumn("up", F.col("before") + F.sum("c").over(Window.partitionBy("p").orderBy("v")))
    at = (F.col("n") - 1) * F.lit(q)
    place = lambda r: F.min(F.when(F.col("up") > r, F.col("v")))
    out = up.agg(F.max("n").alias("n"), place(F.floor(at)).alias("lo"), place(F.ceil(at)).alias("hi"))
    share = (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), (F.col("lo") + share * (F.col("hi") - F.col("lo"))).alias("value"))


def cost(usage: DataFrame, prices: DataFrame, default: str = DEFAULT_MODEL) -> DataFrame:
    """`usage` with cost: a sum over token classes at the model's prices; an unknown model has the default's."""
    known = F.broadcast(prices)  # a price list: a row for each model
    fallback = F.broadcast(prices.filter(F.col("model") == default).select(*[F.col(c).alias(f"d_{c}") for c in prices.columns if c != "model"]))
    joined = usage.join(known, "model", "left").join(fallback)
    price = lambda c: F.coalesce(F.col(c), F.col(f"d_{c}"))
    parts = zip(USAGE, ("p_in", "p_out", "p_read", "p_5m", "p_1h"), strict=False)
    total = sum((F.col(t) * price(p) / 1_000_000 for t, p in parts), F.lit(0.0))
    return joined.withColumn("cost", total).select(*usage.columns, "cost", price("cache_minimum").alias("cache_minimum"))


def spread_per_run(runs: DataFrame, claims: DataFrame, key: str = "run_id") -> DataFrame:
    """(runs, spread): population deviation of claims per run, runs without claims included; null below two runs."""
    per = runs.select(key).distinct().join(claims.groupBy(key).count(), key, "left").select(F.coalesce("count", F.lit(0)).alias("n"))
    return per.agg(F.count("*").alias("runs"), F.when(F.count("*") >= 2, F.round(F.stddev_pop("n"), 6)).alias("spread"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).count().filter("count > 1")


def surplus(df: DataFrame, keys: list[str]) -> DataFrame:
    """(surplus): rows that a unique key would refuse."""
    return duplicates(df, keys).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("surplus"))


def orphans(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose parent does not exist; null references are not orphans."""
    p = parent.select(*[F.col(b).alias(f"__{i}") for i, (_, b) in enumerate(on)])
    cond = [F.col(a) == F.col(f"__{i}") for i, (a, _) in enumerate(on)]
    present = child.filter(" and ".join(f"{a} is not null" for a, _ in on))
    return present.join(p, cond, "left_anti")


def across_tenants(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """(crossing): joined rows whose tenants differ."""
    c, p = child.alias("c"), parent.alias("p")
    return c.join(p, F.col(f"c.{child_key}") == F.col(f"p.{parent_key}")).agg(F.count_if(F.col("c.ws") != F.col("p.ws")).alias("crossing"))


def prf_by(predicted: DataFrame, expected: DataFrame, keys: list[str], by: str | None = None) -> DataFrame:
    """(by, tp, n_predicted, n_expected, precision, recall, f1) on sets of keys."""
    groups = [by] if by else []
    p = predicted.select(*groups, *keys).distinct().withColumn("__p", F.lit(1))
    e = expected.select(*groups, *keys).distinct().withColumn("__e", F.lit(1))
    counts = p.join(e, [*groups, *keys], "full").groupBy(*groups).agg(F.count_if(F.col("__p").isNotNull() & F.col("__e").isNotNull()).alias("tp"), F.count("__p").alias("n_predicted"), F.count("__e").alias("n_expected"))
    out = counts.withColumn("precision", F.coalesce(F.try_divide("tp", "n_predicted"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "n_expected"), F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def prf(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """`prf_by` over all rows."""
    return prf_by(predicted, expected, keys)


def report_markdown(traces: DataFrame) -> DataFrame:
    """(markdown): usage by stage as a table."""
    g = traces.groupBy("stage").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tin"), F.try_divide(F.sum("tokens_cached"), F.sum(total_input())).alias("hit"))
    line = F.format_string("| %s | %d | %d | %.4f |", "stage", "n", "tin", "hit")
    head = "# Report\n\n| stage | calls | tokens in | cache hits |\n|-|-|-|-|\n"
    return g.agg(F.concat(F.lit(head), ordered_text(line, F.col("stage"), separator="\n")).alias("markdown"))
