"""List endpoints, filters, sorts and limits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import listing
from ..sources import bindings as b
from ..sources.bindings import sql
from .registry import query

ASOF = datetime(2024, 1, 20)


@query("op_s6", sql("SELECT id, entity_id, predicate, value FROM v_claims WHERE predicate = 'status' AND status = 'active'", "v_claims"))
def claim_list(spark, d):
    return b.claims(spark, d).filter("predicate = 'status' and status = 'active'").select("id", "entity_id", "predicate", "value")


@query("op_s7", sql("SELECT id, name, entity_type FROM v_entities WHERE id = 'p:42'", "v_entities"))
def point_lookup(spark, d):
    return b.entities(spark, d).filter("id = 'p:42'").select("id", "name", "entity_type")


@query("op_f7", sql("SELECT id FROM v_relations WHERE source_id = 'p:7' OR target_id = 's:7'", "v_relations"))
def either_end(spark, d):
    return b.relations(spark, d).filter("source_id = 'p:7' or target_id = 's:7'").select("id")


@query("op_f8", sql("SELECT id, entity_type FROM v_entities WHERE NOT is_deleted", "v_entities"))
def live_entities(spark, d):
    return b.entities(spark, d).filter("not is_deleted").select("id", "entity_type")


@query("op_f9", sql("SELECT id, epoch_us(occurred_at) AS at FROM v_events WHERE occurred_at >= TIMESTAMP '2024-01-18 00:00:00' ORDER BY occurred_at DESC, id DESC LIMIT 500", "v_events"))
def recent(spark, d):
    return listing.recent(b.events(spark, d), ASOF, at="occurred_at").select("id", F.unix_micros("occurred_at").alias("at"))


@query("op_f21", sql("SELECT id, source_type AS kind, source_id AS source, epoch_us(occurred_at) AS occurred_us, access_level FROM v_events", "v_events"))
def event_dto(spark, d):
    return b.events(spark, d).select("id", F.col("source_type").alias("kind"), F.col("source_id").alias("source"), F.unix_micros("occurred_at").alias("occurred_us"), "access_level")


@query("op_f22", "SELECT d.doc_id AS id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE e.embedding IS NULL ORDER BY d.doc_id LIMIT 100")
def missing_embedding(spark, d):
    docs, v = b.table(spark, d, "documents").select("doc_id"), b.table(spark, d, "embeddings")
    return docs.join(v, docs.doc_id == v.vec_id, "left").filter("embedding is null").orderBy("doc_id").limit(100).select(F.col("doc_id").alias("id"))


@query("op_f23", sql("SELECT entity_type, count(*) AS n FROM v_entities WHERE entity_type <> 'unknown' GROUP BY 1", "v_entities"))
def typed_only(spark, d):
    return b.entities(spark, d).filter("entity_type <> 'unknown'").groupBy("entity_type").agg(F.count("*").alias("n"))


@query("op_f24", sql("SELECT id, name FROM v_entities WHERE length(name) >= 4", "v_entities"))
def long_names(spark, d):
    return b.entities(spark, d).filter(F.length("name") >= 4).select("id", "name")


@query("op_f26", sql("SELECT id, stage, tokens_in FROM v_traces WHERE run_id = 3 ORDER BY id", "v_traces"))
def traces_of_run(spark, d):
    return b.traces(spark, d).filter("run_id = 3").orderBy("id").select("id", "stage", "tokens_in")


@query("op_l1", sql("SELECT id, epoch_us(observed_at) AS at FROM v_claims WHERE (observed_at, id) < (TIMESTAMP '1997-01-01', 500) ORDER BY observed_at DESC, id DESC LIMIT 51", "v_claims"))
def keyset_page(spark, d):
    return listing.page(b.claims(spark, d), 50, (datetime(1997, 1, 1), 500), at="observed_at").select("id", F.unix_micros("observed_at").alias("at"))


@query("op_x35", sql("""SELECT id, translate(base64(encode('["' || id || '","' || entity_id || '"]')), '+/', '-_') AS cursor FROM v_claims""", "v_claims"))
def cursors(spark, d):
    return b.claims(spark, d).select("id", listing.cursor_column(F.col("id"), F.col("entity_id")).alias("cursor"))


@query("op_l3", sql("SELECT * FROM (SELECT 'claim' AS kind, id::VARCHAR AS key, seq AS score FROM v_claims ORDER BY seq DESC, id LIMIT 40) UNION ALL SELECT * FROM (SELECT 'event', id::VARCHAR, id FROM v_events ORDER BY id DESC LIMIT 40) ORDER BY score DESC, kind LIMIT 50", "v_claims", "v_events"))
def two_lists(spark, d):
    c = listing.top_k(b.claims(spark, d).select(F.lit("claim").alias("kind"), F.col("id").cast("string").alias("key"), F.col("seq").alias("score")), 40, F.desc("score"), F.col("key"))
    e = listing.top_k(b.events(spark, d).select(F.lit("event").alias("kind"), F.col("id").cast("string").alias("key"), F.col("id").alias("score")), 40, F.desc("score"))
    return listing.top_k(c.unionByName(e), 50, F.desc("score"), F.col("kind"))


@query("op_l4", sql(", few AS (SELECT id, access_level FROM v_events ORDER BY value DESC, id LIMIT 60) SELECT id FROM few WHERE access_level = 'public' ORDER BY id LIMIT 20", "v_events"))
def over_fetch(spark, d):
    few = listing.top_k(b.events(spark, d), 60, F.desc("value"), F.col("id"))
    return few.filter("access_level = 'public'").orderBy("id").limit(20).select("id")


@query("op_l5", "SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_size END AS size FROM part ORDER BY size DESC NULLS LAST, p_partkey LIMIT 300")
def nulls_last(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    return listing.top_k(p, 300, F.desc_nulls_last("size"), F.col("id"))


@query("op_l7", sql(", newest AS (SELECT * FROM v_entities ORDER BY n % 97 DESC, id LIMIT 200) SELECT id, name FROM newest WHERE entity_type = 'person'", "v_entities"))
def snapshot_then_filter(spark, d):
    return listing.top_k(b.entities(spark, d).withColumn("at", F.col("n") % 97), 200, F.desc("at"), F.col("id")).filter("entity_type = 'person'").select("id", "name")


@query("op_l8", sql("SELECT id FROM v_entities ORDER BY n, id LIMIT 500", "v_entities"))
def triage_head(spark, d):
    return listing.top_k(b.entities(spark, d), 500, F.col("n"), F.col("id")).select("id")


@query("op_l9", sql("SELECT id FROM v_events WHERE access_level = 'restricted' AND NOT EXISTS (SELECT 1 FROM v_claim_sources s WHERE s.event_id = v_events.id) ORDER BY occurred_at, id LIMIT 50", "v_events", "v_claim_sources"))
def work_queue(spark, d):
    e, s = b.events(spark, d).filter("access_level = 'restricted'"), b.claim_sources(spark, d)
    return listing.top_k(e.join(s, e.id == s.event_id, "left_anti"), 50, F.col("occurred_at"), F.col("id")).select("id")


NODES = "SELECT r_name AS path, r_regionkey AS sort_order FROM region UNION ALL SELECT r_name || '/' || n_name, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name || '/' || n_name || '/' || s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def nodes(spark, d):
    r, n, s = (b.table(spark, d, t) for t in ("region", "nation", "supplier"))
    rn = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # a fixed list of regions
    sn = s.join(rn, s.s_nationkey == rn.n_nationkey)
    top = r.select(F.col("r_name").alias("path"), F.col("r_regionkey").cast("bigint").alias("sort_order"))
    mid = rn.select(F.concat_ws("/", "r_name", "n_name").alias("path"), F.col("n_nationkey").cast("bigint").alias("sort_order"))
    low = sn.select(F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), F.col("s_suppkey").alias("sort_order"))
    return top.unionByName(mid).unionByName(low)


@query("op_l10", f"WITH nodes AS ({NODES}) SELECT path, sort_order FROM nodes WHERE starts_with(path, (SELECT min(r_name) FROM region) || '/') AND len(path) - len(replace(path, '/', '')) = 1")
def tree_children(spark, d):
    first = b.table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return listing.children(nodes(spark, d), first)


@query("op_u2", sql("SELECT id FROM v_events WHERE id % 50 = 0 UNION SELECT id FROM v_events WHERE occurred_at >= TIMESTAMP '2024-01-18'", "v_events"))
def dirty_or_recent(spark, d):
    e = b.events(spark, d)
    return e.filter("id % 50 = 0").select("id").union(e.filter(F.col("occurred_at") >= F.lit("2024-01-18").cast("timestamp")).select("id")).distinct()
