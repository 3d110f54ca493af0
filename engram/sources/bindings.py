"""Logical memory tables over the physical ones, in Spark and as DuckDB SQL.

Every accessor takes (spark, sf_dir) and returns a lazy projection, so filters
and column choices of the operators reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _level(key: str):
    m = F.col(key) % 10
    return F.when(m < 6, "public").when(m < 8, "channel").when(m == 8, "private").otherwise("restricted")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l0 events: (ws, id, source_type, source_id, occurred_at, access_level, actor, raw_text, value)."""
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 3).alias("ws"),
        F.col("event_id").alias("id"),
        F.col("event_type").alias("source_type"),
        F.concat_ws(":", "event_type", F.col("event_id").cast("string")).alias("source_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        _level("event_id").alias("access_level"),
        F.col("user_id").alias("actor"),
        F.col("props").alias("raw_text"),
        "value",
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_type, name, is_deleted, n): customers are persons, suppliers teams, parts projects."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), F.lit("person").alias("entity_type"), F.col("c_name").alias("name"), F.col("c_custkey").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.lit("team").alias("entity_type"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("n"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p:"), "p_partkey").alias("id"), F.lit("project").alias("entity_type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("n"))
    return c.unionByName(s).unionByName(p).select("id", "entity_type", "name", (F.col("n") % 50 == 0).alias("is_deleted"), "n")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity_id, predicate, value, observed_at, seq, status, confidence): one claim for each order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("c:"), "o_custkey").alias("entity_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "status").otherwise("priority").alias("predicate"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("value"),
        F.col("o_orderdate").cast("timestamp").alias("observed_at"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 11 == 0, "retracted").otherwise("active").alias("status"),
        ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"),
    )


def claim_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, event_id): every seventh claim has no source."""
    n = table(spark, sf_dir, "events").agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0").select("o_orderkey")
    return o.join(F.broadcast(n)).select(F.col("o_orderkey").alias("claim_id"), (F.col("o_orderkey") % F.col("n")).alias("event_id"))  # n is one row


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_id, target_id, relation_type, created_at): parts supplied by suppliers, with natural repeats."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.concat(F.lit("p:"), "l_partkey").alias("source_id"),
        F.concat(F.lit("s:"), "l_suppkey").alias("target_id"),
        F.lit("supplied_by").alias("relation_type"),
        F.col("l_shipdate").cast("timestamp").alias("created_at"),
        "l_orderkey",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, source_type, content, embedding, access_level)."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = F.when(F.col("doc_id") % 3 == 0, "chunk").when(F.col("doc_id") % 3 == 1, "claim").otherwise("entity")
    return v.join(d, "doc_id").select(F.col("doc_id").alias("id"), kind.alias("source_type"), F.col("text").alias("content"), "embedding", _level("doc_id").alias("access_level"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, run_id, stage, model, duration_ms, tokens_in, tokens_out, tokens_cached, cache_write_5m, cache_write_1h, cost_usd)."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        k.alias("id"),
        F.col("user_id").alias("run_id"),
        F.col("event_type").alias("stage"),
        F.when(k % 4 == 0, "model-small").when(k % 4 == 1, "model-large").otherwise("model-medium").alias("model"),
        F.floor(F.col("value") * 10).cast("bigint").alias("duration_ms"),
        (k % 1000).alias("tokens_in"),
        (k % 300).alias("tokens_out"),
        (k % 700).alias("tokens_cached"),
        (k % 50).alias("cache_write_5m"),
        (k % 20).alias("cache_write_1h"),
        ((k % 97) / 1000.0).alias("cost_usd"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, author, text)."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("author"), "text")


_LEVEL = "CASE WHEN {0} % 10 < 6 THEN 'public' WHEN {0} % 10 < 8 THEN 'channel' WHEN {0} % 10 = 8 THEN 'private' ELSE 'restricted' END"

#: The same views for DuckDB.
SQL = {
    "v_events": f"SELECT user_id % 3 AS ws, event_id AS id, event_type AS source_type, event_type || ':' || event_id AS source_id, ts AS occurred_at, {_LEVEL.format('event_id')} AS access_level, user_id AS actor, props AS raw_text, value FROM events",
    "v_entities": "SELECT 'c:' || c_custkey AS id, 'person' AS entity_type, c_name AS name, c_custkey % 50 = 0 AS is_deleted, c_custkey AS n FROM customer UNION ALL SELECT 's:' || s_suppkey, 'team', s_name, s_suppkey % 50 = 0, s_suppkey FROM supplier UNION ALL SELECT 'p:' || p_partkey, 'project', p_name, p_partkey % 50 = 0, p_partkey FROM part",
    "v_claims": "SELECT o_orderkey AS id, 'c:' || o_custkey AS entity_id, CASE WHEN o_orderkey % 2 = 0 THEN 'status' ELSE 'priority' END AS predicate, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value, o_orderdate AS observed_at, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'retracted' ELSE 'active' END AS status, (o_orderkey % 100) / 100.0::DOUBLE AS confidence FROM orders",
    "v_claim_sources": "SELECT o_orderkey AS claim_id, o_orderkey % (SELECT count(*) FROM events) AS event_id FROM orders WHERE o_orderkey % 7 <> 0",
    "v_relations": "SELECT l_orderkey || '-' || l_linenumber AS id, 'p:' || l_partkey AS source_id, 's:' || l_suppkey AS target_id, 'supplied_by' AS relation_type, l_shipdate AS created_at, l_orderkey FROM lineitem",
    "v_vectors": f"SELECT vec_id AS id, CASE vec_id % 3 WHEN 0 THEN 'chunk' WHEN 1 THEN 'claim' ELSE 'entity' END AS source_type, text AS content, embedding, {_LEVEL.format('vec_id')} AS access_level FROM embeddings JOIN documents ON vec_id = doc_id",
    "v_traces": "SELECT event_id AS id, user_id AS run_id, event_type AS stage, CASE event_id % 4 WHEN 0 THEN 'model-small' WHEN 1 THEN 'model-large' ELSE 'model-medium' END AS model, floor(value * 10)::BIGINT AS duration_ms, event_id % 1000 AS tokens_in, event_id % 300 AS tokens_out, event_id % 700 AS tokens_cached, event_id % 50 AS cache_write_5m, event_id % 20 AS cache_write_1h, (event_id % 97) / 1000.0::DOUBLE AS cost_usd FROM events",
    "v_turns": "SELECT conv_id, turn, role AS author, text FROM conversations",
}


def sql(body: str, *views: str, recursive: bool = False) -> str:
    """A DuckDB statement over the named views; `body` may start with further common table expressions after a comma."""
    head = ", ".join(f"{v} AS ({SQL[v]})" for v in views)
    if not head:
        return body
    return f"WITH {'RECURSIVE ' * recursive}{head}{body if body.lstrip().startswith(',') else ' ' + body}"
