"""Queries over streams, tables of changes, and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, table_functions
from ..operators.restamping import Restamp
from ..sources import bindings as b
from ..sources.bindings import sql
from ..sources.storage import fresh
from ..streaming import dirty, limits, upsert
from .access import ACCESS, CLAIM_VIEWS
from .graph import RANK
from .registry import query

WITH_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files; a pattern names it, because it may be a single file or a folder."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/{name}.parque[t]")


def run_out(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives until its source has no more, as a table in the shared folder."""
    spark = stream.sparkSession
    out = fresh(spark, name)
    kept = spark.conf.get(WITH_DATA, "true")
    spark.conf.set(WITH_DATA, "false")
    try:
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(WITH_DATA, kept)
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


@query("op_t1", "SELECT user_id AS ws, event_id AS id, 'count' AS reason FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 10) GROUP BY user_id, event_id")
def drain(spark, d):
    """Changed ids of each user, drained at ten; the table is one micro-batch, so sets come out whole."""
    changes = stream_of(spark, d, "events").select(F.col("user_id").alias("ws"), F.col("event_id").alias("id"))
    return run_out(dirty.drained(changes), "drain").select("ws", "id", "reason")


@query("op_t4", "WITH fired AS (SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_id) >= 10) SELECT DISTINCT user_id AS ws, event_id AS id FROM events WHERE user_id IN (SELECT user_id FROM fired) UNION SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM fired) AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 48 HOUR")
def drain_with_recent(spark, d):
    """Drained ids with the tenant's orders of the last 48 hours of the table."""
    o = b.table(spark, d, "orders").select(F.col("o_custkey").alias("ws"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    as_of = o.agg(F.max("updated_at")).first()[0]
    return dirty.with_recent(drain(spark, d), o, as_of)


@query("op_t5_stream")
def limiter(spark, d):
    """`op_t5` online: three requests in an hour for each actor, the table's files as a stream; tested against the replay."""
    e = stream_of(spark, d, "events").select(F.col("user_id").alias("actor"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return run_out(limits.rate_limited(e, "actor", "at", 3, 3600.0), "limiter").withColumnRenamed("key", "actor")


@query("op_s2_runs", sql(f", r AS (SELECT 0 AS run, source_type, source_id, raw_text, access_level FROM v_events WHERE id % 3 <> 0 UNION ALL SELECT 1, source_type, source_id, CASE WHEN id % 2 = 0 THEN 'edited' END, CASE WHEN id % 4 = 0 THEN 'private' ELSE 'public' END FROM v_events WHERE id % 5 = 0 UNION ALL SELECT 2, source_type, source_id, 'last', 'channel' FROM v_events WHERE id % 50 = 0) SELECT source_type, source_id, arg_max(raw_text, run) FILTER (WHERE raw_text IS NOT NULL) AS raw_text, CASE max({RANK.format('access_level')}) WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' ELSE 'restricted' END AS access_level FROM r GROUP BY source_type, source_id", "v_events"))
def upsert_runs(spark, d):
    """Three batches of events as runs of a keyed table, merged on read."""
    e = b.events(spark, d)
    table = upsert.event_table(spark, fresh(spark, "events"), {"raw_text": "string"})
    table.add(e.filter("id % 3 <> 0"), 0)
    table.add(e.filter("id % 5 = 0").withColumns({"raw_text": F.when(F.col("id") % 2 == 0, "edited"), "access_level": F.when(F.col("id") % 4 == 0, "private").otherwise("public")}), 1)
    table.add(e.filter("id % 50 = 0").withColumns({"raw_text": F.lit("last"), "access_level": F.lit("channel")}), 2)
    return table.read()


@query("op_a3_changes", sql(f"{ACCESS} SELECT c.entity_id, max(a.max_tier_rank)::INT AS max_tier_rank, CASE max(a.max_tier_rank) WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' ELSE 'restricted' END AS access_level FROM v_claims c JOIN access a ON a.claim_id = c.id GROUP BY c.entity_id", *CLAIM_VIEWS))
def restamp_changes(spark, d):
    """Entities' access after a second change: a fifth of the events had other levels, a quarter of the sources come late, and a ninth were others."""
    state = Restamp(spark, fresh(spark, "restamp"))
    levels = b.events(spark, d).select(F.col("id").alias("event_id"), "access_level")
    owners = b.claims(spark, d).select(F.col("id").alias("claim_id"), "entity_id", F.lit(1).alias("n"))
    links = b.claim_sources(spark, d).withColumn("n", F.lit(1))
    wrong = links.filter("claim_id % 9 = 0").withColumn("event_id", F.col("event_id") + 1)
    other = F.when(F.col("access_level") == "public", "restricted").otherwise("public")
    state.apply(0, levels.withColumn("access_level", F.when(F.col("event_id") % 5 == 0, other).otherwise(F.col("access_level"))), links.filter("claim_id % 4 <> 0").unionByName(wrong), owners)
    state.apply(1, levels.filter("event_id % 5 = 0"), links.filter("claim_id % 4 = 0").unionByName(wrong.withColumn("n", F.lit(-1))))
    return state.entity_access()


@query("op_y6")
def chunks_in_sql(spark, d):
    """`op_c5` as SQL over a table function; tested against it."""
    table_functions.register(spark)
    docs = b.table(spark, d, "documents")
    docs.select("doc_id", F.posexplode_outer(chunking.paragraphs(F.coalesce("text", F.lit("")))).alias("at", "paragraph")).createOrReplaceTempView("engram_paragraphs")
    return spark.sql("SELECT doc_id, chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INT) AS total, chunk, n_tokens FROM pack_chunks(TABLE(engram_paragraphs), 'doc_id', 'at', 'paragraph', '\n\n', 500)")
