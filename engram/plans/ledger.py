"""Rollups of the run ledger, quality proxies and integrity checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rollups as r
from ..operators import search
from ..sources import bindings as b
from ..sources.bindings import sql
from .registry import query

SUMS = "coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out, coalesce(sum(tokens_cached), 0)::BIGINT AS tokens_cached, coalesce(sum(cache_write_5m), 0)::BIGINT AS cache_write_5m, coalesce(sum(cache_write_1h), 0)::BIGINT AS cache_write_1h"
INPUT = "(tokens_in + tokens_cached + cache_write_5m + cache_write_1h)"
PRICE = "(SELECT * FROM (VALUES ('model-small', 0.80::DOUBLE, 4.0::DOUBLE, 0.08::DOUBLE, 1.00::DOUBLE, 1.60::DOUBLE, 4096), ('model-medium', 3.00, 15.0, 0.30, 3.75, 6.00, 2048), ('model-large', 15.0, 75.0, 1.50, 18.75, 30.0, 2048)) p(model, p_in, p_out, p_read, p_5m, p_1h, cache_minimum))"
COST = "tokens_in * p_in / 1000000 + tokens_out * p_out / 1000000 + tokens_cached * p_read / 1000000 + cache_write_5m * p_5m / 1000000 + cache_write_1h * p_1h / 1000000"


def runs(spark, d):
    """A run for each customer, with counters that a rollup replaces."""
    c = b.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))
    return c.select("run_id", *[F.lit(-1).cast("double" if x == "cost_usd" else "bigint").alias(x) for x in r.USAGE])


@query("op_a6", sql(f", sums AS (SELECT run_id, {SUMS}, round(sum(cost_usd), 6) AS cost_usd FROM v_traces GROUP BY 1) SELECT c_custkey AS run_id, coalesce(tokens_in, -1) AS tokens_in, coalesce(tokens_out, -1) AS tokens_out, coalesce(tokens_cached, -1) AS tokens_cached, coalesce(cache_write_5m, -1) AS cache_write_5m, coalesce(cache_write_1h, -1) AS cache_write_1h, coalesce(cost_usd, -1) AS cost_usd FROM customer LEFT JOIN sums ON run_id = c_custkey", "v_traces"))
def usage_rollup(spark, d):
    return r.roll_up_usage(runs(spark, d), b.traces(spark, d)).withColumn("cost_usd", F.round("cost_usd", 6))


@query("op_a7", sql("SELECT id, CASE WHEN id % 5 = 0 THEN 17 ELSE tokens_in + tokens_out END AS tokens_used FROM v_traces", "v_traces"))
def tokens_used(spark, d):
    return b.traces(spark, d).select("id", r.tokens_used(F.when(F.col("id") % 5 == 0, F.lit(17).cast("bigint"))).alias("tokens_used"))


@query("op_a10", sql(f"SELECT stage, round(sum(tokens_cached) / sum({INPUT}), 4) AS hit_ratio FROM v_traces GROUP BY stage", "v_traces"))
def hit_ratio(spark, d):
    return r.cache_hit_ratio(b.traces(spark, d))


@query("op_a11", sql("SELECT stage, count(duration_ms) AS n, CASE WHEN count(duration_ms) >= 5 THEN quantile_disc(duration_ms, 0.5) END AS p50, CASE WHEN count(duration_ms) >= 5 THEN quantile_disc(duration_ms, 0.95) END AS p95 FROM v_traces GROUP BY stage", "v_traces"))
def latency(spark, d):
    return r.latency(b.traces(spark, d))


@query("op_a12", sql(", per AS (SELECT c_custkey, count(c.id) AS n FROM customer LEFT JOIN v_claims c ON c.entity_id = 'c:' || c_custkey GROUP BY 1) SELECT count(*) AS runs, round(stddev_pop(n), 6) AS spread FROM per", "v_claims"))
def claims_spread(spark, d):
    claims = b.claims(spark, d).select(F.substring_index("entity_id", ":", -1).cast("bigint").alias("run_id"))
    return r.spread_per_run(runs(spark, d), claims)


@query("op_a13", sql("SELECT round(avg((predicate = 'status')::INT), 6) AS status_rate, round(count(*) / count(DISTINCT entity_id), 6) AS claims_per_entity, count(*) FILTER (WHERE status = 'retracted') AS failures, count(*) AS n_claims FROM v_claims", "v_claims"))
def quality_proxies(spark, d):
    c = b.claims(spark, d)
    per_entity = c.groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("predicate") == "status").alias("s"), F.count_if(F.col("status") == "retracted").alias("f"))
    return per_entity.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("status_rate"), F.round(F.sum("n") / F.count("*"), 6).alias("claims_per_entity"), F.sum("f").alias("failures"), F.sum("n").alias("n_claims"))


@query("op_a16", sql(f"SELECT stage, {SUMS}, sum({INPUT})::BIGINT AS total_input, round(sum(tokens_cached) / sum({INPUT}), 6) AS hit FROM v_traces GROUP BY stage", "v_traces"))
def usage_combine(spark, d):
    u = r.usage_by(b.traces(spark, d), "stage").drop("cost_usd").withColumn("total_input", r.total_input())
    return u.withColumn("hit", F.round(F.col("tokens_cached") / F.col("total_input"), 6))


@query("op_a17", sql(f"SELECT t.id, round({COST}, 9) AS cost FROM v_traces t LEFT JOIN {PRICE} p ON p.model = CASE t.model WHEN 'model-large' THEN 'model-large' WHEN 'model-small' THEN 'model-small' ELSE 'model-medium' END", "v_traces"))
def cost(spark, d):
    t = b.traces(spark, d).withColumn("model", F.when(F.col("model") == "model-medium", "unheard-of").otherwise(F.col("model")))
    return r.cost(t, r.price_table(spark)).select("id", F.round("cost", 9).alias("cost"))


@query("op_a24", sql(f"SELECT t.id, {INPUT} AS total_input, round(tokens_cached / {INPUT}, 4) AS hit_ratio FROM v_traces t JOIN {PRICE} p ON p.model = t.model WHERE {INPUT} < p.cache_minimum AND {INPUT} > 0", "v_traces"))
def cache_alarms(spark, d):
    t = r.cost(b.traces(spark, d), r.price_table(spark)).withColumn("total_input", r.total_input())
    return t.filter("total_input < cache_minimum and total_input > 0").select("id", "total_input", F.round(F.col("tokens_cached") / F.col("total_input"), 4).alias("hit_ratio"))


@query("op_a18", sql("SELECT predicate, count(*) FILTER (WHERE status = 'active') AS created, count(*) FILTER (WHERE status = 'retracted') AS retracted, count(DISTINCT entity_id) AS entities FROM v_claims GROUP BY predicate", "v_claims"))
def write_counters(spark, d):
    return b.claims(spark, d).groupBy("predicate").agg(F.count_if(F.col("status") == "active").alias("created"), F.count_if(F.col("status") == "retracted").alias("retracted"), F.countDistinct("entity_id").alias("entities"))


@query("op_a19", sql("SELECT run_id, count(*) AS chunks, count(*) FILTER (WHERE stage = 'click') AS crystal, count(*) FILTER (WHERE stage = 'error') AS skipped, round(sum(cost_usd), 6) AS cost_usd FROM v_traces GROUP BY run_id", "v_traces"))
def chunk_counters(spark, d):
    return b.traces(spark, d).groupBy("run_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("stage") == "click").alias("crystal"), F.count_if(F.col("stage") == "error").alias("skipped"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


@query("op_a20", ", ".join(["WITH p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)", "e AS (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en')", "c AS (SELECT (SELECT count(*) FROM p JOIN e USING (doc_id)) AS tp, (SELECT count(*) FROM p) AS n_predicted, (SELECT count(*) FROM e) AS n_expected)"]) + " SELECT tp, n_predicted, n_expected, round(tp / n_predicted, 9) AS precision, round(tp / n_expected, 9) AS recall, round(2 * (tp / n_predicted) * (tp / n_expected) / (tp / n_predicted + tp / n_expected), 9) AS f1 FROM c")
def precision_recall(spark, d):
    p, e = b.table(spark, d, "labels").filter("quality = 1"), b.table(spark, d, "documents").filter("lang = 'en'")
    out = r.prf(p, e, ["doc_id"])
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("op_a21", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)")
def preflight(spark, d):
    return r.surplus(b.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("op_a22", sql("SELECT round(avg(CASE WHEN tokens_in < tokens_cached THEN 1.0 ELSE 0.0 END), 9) AS agreement, round(quantile_cont(duration_ms, 0.95), 6) AS p95 FROM v_traces", "v_traces"))
def agreement(spark, d):
    t = b.traces(spark, d)
    agreed = t.agg(F.round(F.avg(F.when(F.col("tokens_in") < F.col("tokens_cached"), 1.0).otherwise(0.0)), 9).alias("agreement"))
    return agreed.join(r.percentile_cont(t, "duration_ms", 0.95).select(F.round("value", 6).alias("p95")))  # one row and one row


@query("op_a23", "SELECT count(*) FILTER (WHERE p_brand = 'Brand#1') AS core_seeds, count(*) FILTER (WHERE p_brand <> 'Brand#1') AS others FROM part")
def health(spark, d):
    return b.table(spark, d, "part").agg(F.count_if(F.col("p_brand") == "Brand#1").alias("core_seeds"), F.count_if(F.col("p_brand") != "Brand#1").alias("others"))


@query("op_a15", "SELECT count(*) AS total, count(*) FILTER (WHERE quality = 1) AS crystal, round(100.0 * count(*) FILTER (WHERE quality = 1) / count(*), 4) AS crystal_pct, sum(toxic)::BIGINT AS changed FROM labels")
def run_comparison(spark, d):
    x = b.table(spark, d, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("crystal"), F.sum(F.col("toxic").cast("bigint")).alias("changed"))
    return x.withColumn("crystal_pct", F.round(100.0 * F.col("crystal") / F.col("total"), 4))


@query("op_a5", sql("SELECT entity_id, max(len(list_filter(string_split_regex(lower(predicate || ' ' || value), '[^a-z0-9]+'), lambda w: w IN ('priority', 'high', 'urgent'))))::BIGINT AS best FROM v_claims GROUP BY entity_id", "v_claims"))
def best_rank(spark, d):
    """The best text rank among an entity's claims."""
    rank = search.WebQuery.parse("priority high urgent").rank(search.tokens(F.concat_ws(" ", "predicate", "value")))
    return b.claims(spark, d).groupBy("entity_id").agg(F.max(rank).cast("bigint").alias("best"))


@query("op_q1", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey < 20)")
def orphan_check(spark, d):
    parent = b.table(spark, d, "supplier").filter("s_nationkey < 20")
    return r.orphans(b.table(spark, d, "lineitem"), parent, [("l_suppkey", "s_suppkey")]).select("l_orderkey", "l_linenumber")


@query("op_q2", "SELECT l_partkey, l_suppkey, count(*) AS count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, d):
    return r.duplicates(b.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@query("op_q3", sql("SELECT id FROM v_traces WHERE nullif(run_id % 7, 0) IS NULL AND nullif(tokens_out % 5, 0) IS NULL", "v_traces"))
def parent_check(spark, d):
    t = b.traces(spark, d).withColumns({"run": F.nullif(F.col("run_id") % 7, F.lit(0)), "integrator": F.nullif(F.col("tokens_out") % 5, F.lit(0))})
    return t.filter("run is null and integrator is null").select("id")


CROSS = "SELECT count(*) FILTER (WHERE o_custkey % 3 <> c_custkey % 4) AS crossing FROM orders JOIN customer ON o_custkey = c_custkey"


def _crossing(spark, d):
    o = b.table(spark, d, "orders").select("o_custkey", (F.col("o_custkey") % 3).alias("ws"))
    c = b.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("ws"))
    return r.across_tenants(o, c, "o_custkey", "c_custkey")


query("op_j19", CROSS)(_crossing)
query("op_q4", CROSS)(_crossing)


@query("op_q5", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 END, c_custkey % 4) AS ws FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def tenant_backfill(spark, d):
    o = b.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 5).alias("ws"))
    c = b.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("parent_ws"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(F.col("o_orderkey").alias("id"), F.coalesce("ws", "parent_ws").alias("ws"))


@query("op_q6", sql(", g AS (SELECT entity_id, count(*) AS n, count(confidence) AS m, sum(confidence::DECIMAL(18, 9)) AS s FROM v_claims GROUP BY 1) SELECT entity_id, n, round(s::DOUBLE / m, 9) AS mean_confidence FROM g WHERE n > 12 OR s < 0.4 * m", "v_claims"))
def anomalies(spark, d):
    """Entities of many claims or little confidence; summed in decimals, so a mean at the bound does not hang on the order of rows."""
    sums = F.count("confidence").alias("m"), F.sum(F.col("confidence").cast("decimal(18,9)")).alias("s")
    g = b.claims(spark, d).groupBy("entity_id").agg(F.count("*").alias("n"), *sums)
    return g.filter("n > 12 or s < 0.4 * m").select("entity_id", "n", F.round(F.col("s").cast("double") / F.col("m"), 9).alias("mean_confidence"))


@query("op_t8", "WITH last AS (SELECT user_id AS event_id, arg_max(event_type, event_id) AS state, max(event_id) AS run FROM events GROUP BY 1) SELECT event_id, run, CASE WHEN state = 'signup' THEN 'reuse' WHEN state = 'error' THEN 'retry' ELSE 'new_child' END AS decision FROM last")
def run_reuse(spark, d):
    e = b.table(spark, d, "events").groupBy(F.col("user_id").alias("event_id")).agg(F.max_by("event_type", "event_id").alias("state"), F.max("event_id").alias("run"))
    return e.select("event_id", "run", F.when(F.col("state") == "signup", "reuse").when(F.col("state") == "error", "retry").otherwise("new_child").alias("decision"))


@query("op_t9", sql("SELECT id, CASE WHEN source_type = 'click' AND occurred_at < TIMESTAMP '2024-01-10' - INTERVAL 900 SECOND THEN 'failed' ELSE source_type END AS state FROM v_events", "v_events"))
def reaper(spark, d):
    stale = (F.col("source_type") == "click") & (F.col("occurred_at") < F.lit("2024-01-10").cast("timestamp") - F.expr("INTERVAL 900 SECOND"))
    return b.events(spark, d).select("id", F.when(stale, "failed").otherwise(F.col("source_type")).alias("state"))
