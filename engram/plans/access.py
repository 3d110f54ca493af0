"""Tenant, access and visibility queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.access import Caller, rank_to_level, register_sql_functions, tier_rank
from ..operators import listing, visibility
from ..sources import bindings as b
from ..sources.bindings import sql
from .registry import query

READER, WRITER, ADMIN = Caller(0, ("read",)), Caller(0, ("write",)), Caller(0, ("admin",))
RANK = "CASE {0} WHEN 'public' THEN 0 WHEN 'channel' THEN 1 WHEN 'private' THEN 2 ELSE 3 END"
ACCESS = f", access AS (SELECT c.id AS claim_id, coalesce(max({RANK.format('e.access_level')}) FILTER (WHERE e.id IS NOT NULL), 3) AS max_tier_rank FROM v_claims c LEFT JOIN v_claim_sources s ON s.claim_id = c.id LEFT JOIN v_events e ON e.id = s.event_id GROUP BY c.id)"
CLAIM_VIEWS = ("v_events", "v_claims", "v_claim_sources")


def access_of(spark, d):
    return visibility.effective_access(b.claims(spark, d), b.claim_sources(spark, d), b.events(spark, d))


@query("op_f1", sql("SELECT id, source_id FROM v_events WHERE ws = 0", "v_events"))
def tenant_filter(spark, d):
    return visibility.of_workspace(b.events(spark, d), READER).select("id", "source_id")


@query("op_f2", sql("SELECT id, access_level FROM v_events WHERE access_level IN ('public', 'channel')", "v_events"))
def level_filter(spark, d):
    return visibility.by_level(b.events(spark, d), READER).select("id", "access_level")


@query("op_a1", sql(f"{ACCESS} SELECT claim_id, max_tier_rank FROM access", *CLAIM_VIEWS))
def effective_access(spark, d):
    return access_of(spark, d)


@query("op_j2", sql(", chain AS (SELECT c.id AS claim_id, s.event_id, e.access_level FROM v_claims c LEFT JOIN v_claim_sources s ON s.claim_id = c.id LEFT JOIN v_events e ON e.id = s.event_id) SELECT claim_id, count(event_id) AS n_sources, max(access_level) AS a_level FROM chain GROUP BY claim_id", *CLAIM_VIEWS))
def source_chain(spark, d):
    c, s, e = b.claims(spark, d), b.claim_sources(spark, d), b.events(spark, d)
    chain = c.select(F.col("id").alias("claim_id")).join(s, "claim_id", "left").join(e.select(F.col("id").alias("event_id"), "access_level"), "event_id", "left")
    return chain.groupBy("claim_id").agg(F.count("event_id").alias("n_sources"), F.max("access_level").alias("a_level"))


@query("op_f3", sql(f"{ACCESS} SELECT c.id, c.value FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE a.max_tier_rank <= 2", *CLAIM_VIEWS))
def threshold_filter(spark, d):
    return visibility.visible_claims(b.claims(spark, d), access_of(spark, d), WRITER).select("id", "value")


@query("op_a2", sql(f"{ACCESS} SELECT c.entity_id, max(a.max_tier_rank) AS max_tier_rank, CASE max(a.max_tier_rank) WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' ELSE 'restricted' END AS access_level FROM v_claims c JOIN access a ON a.claim_id = c.id GROUP BY c.entity_id", *CLAIM_VIEWS))
def entity_access(spark, d):
    return visibility.entity_access(b.claims(spark, d), access_of(spark, d))


@query("op_a3", sql(f"{ACCESS}, ent AS (SELECT 'c:' || v.id AS entity_id, v.access_level FROM v_vectors v), r AS (SELECT c.entity_id, max(a.max_tier_rank) AS m FROM v_claims c JOIN access a ON a.claim_id = c.id GROUP BY 1) SELECT ent.entity_id, coalesce(CASE r.m WHEN 0 THEN 'public' WHEN 1 THEN 'channel' WHEN 2 THEN 'private' WHEN 3 THEN 'restricted' END, ent.access_level) AS access_level FROM ent LEFT JOIN r ON r.entity_id = ent.entity_id", *CLAIM_VIEWS, "v_vectors"))
def restamp(spark, d):
    chunks = b.vectors(spark, d).select(F.concat(F.lit("c:"), "id").alias("entity_id"), "access_level")
    ranks = visibility.entity_access(b.claims(spark, d), access_of(spark, d)).select("entity_id", "max_tier_rank")
    return visibility.restamped(chunks, ranks, "entity_id")


FLAGS = f"{ACCESS}, flags AS (SELECT c.entity_id, max((c.status = 'active' AND a.max_tier_rank <= 1)::INT) AS seen FROM v_claims c JOIN access a ON a.claim_id = c.id GROUP BY c.entity_id), flagged AS (SELECT e.*, f.seen IS NOT NULL AS has_claims, coalesce(f.seen, 0) = 1 AS sees_claim FROM v_entities e LEFT JOIN flags f ON f.entity_id = e.id)"


@query("op_f4", sql(f"{FLAGS} SELECT id, has_claims, sees_claim FROM flagged WHERE sees_claim OR NOT has_claims", *CLAIM_VIEWS, "v_entities"))
def entities_seen(spark, d):
    return visibility.visible_entities(b.entities(spark, d), b.claims(spark, d), access_of(spark, d), READER).select("id", "has_claims", "sees_claim")


@query("op_f5", sql(f"{FLAGS} SELECT id, CASE WHEN has_claims THEN NULL ELSE name END AS description, CASE WHEN has_claims THEN '{{}}' ELSE '{{\"n\":' || n || '}}' END AS properties FROM flagged", *CLAIM_VIEWS, "v_entities"))
def masking(spark, d):
    flagged = visibility.entity_flags(b.entities(spark, d), b.claims(spark, d), access_of(spark, d), READER)
    flagged = flagged.withColumns({"description": F.col("name"), "properties": F.to_json(F.struct("n"))})
    return visibility.masked(flagged, READER, {"description": "cast(null as string)", "properties": "'{}'"}).select("id", "description", "properties")


def _customer_relations(spark, d):
    """Customers who placed orders at the same place of the key order: an edge between consecutive customers, sourced by events."""
    c = b.table(spark, d, "customer")
    rel = c.select(F.concat(F.lit("r:"), "c_custkey").alias("id"), F.concat(F.lit("c:"), "c_custkey").alias("source_id"), F.concat(F.lit("c:"), F.col("c_custkey") + 1).alias("target_id"), "c_custkey")
    src = rel.filter("c_custkey % 5 <> 0").select(F.col("id").alias("relation_id"), F.col("c_custkey").alias("event_id"))
    return rel.drop("c_custkey"), src


@query("op_f6", sql(f"{ACCESS}, seen AS (SELECT DISTINCT c.entity_id FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE a.max_tier_rank <= 1 AND c.status = 'active'), rel AS (SELECT 'r:' || c_custkey AS id, 'c:' || c_custkey AS source_id, 'c:' || (c_custkey + 1) AS target_id, c_custkey FROM customer), open AS (SELECT r.id, max(({RANK.format('e.access_level')} <= 1)::INT) AS o FROM rel r JOIN v_events e ON e.id = r.c_custkey WHERE r.c_custkey % 5 <> 0 GROUP BY r.id) SELECT r.id, r.source_id, r.target_id FROM rel r JOIN open ON open.id = r.id AND open.o = 1 WHERE r.source_id IN (SELECT entity_id FROM seen) AND r.target_id IN (SELECT entity_id FROM seen)", *CLAIM_VIEWS))
def relations_seen(spark, d):
    rel, src = _customer_relations(spark, d)
    out = visibility.visible_relations(rel, src, b.events(spark, d), b.claims(spark, d), access_of(spark, d), READER)
    return out.select("id", "source_id", "target_id")


@query("op_j1", sql(f"{ACCESS} SELECT c.id, c.entity_id, a.max_tier_rank FROM v_claims c JOIN access a ON a.claim_id = c.id", *CLAIM_VIEWS))
def claims_with_access(spark, d):
    c, a = b.claims(spark, d), access_of(spark, d)
    return c.join(a, c.id == a.claim_id).select("id", "entity_id", "max_tier_rank")


@query("op_j3", sql(f"{ACCESS} SELECT e.id FROM v_entities e WHERE EXISTS (SELECT 1 FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE c.entity_id = e.id AND c.status = 'active' AND a.max_tier_rank <= 1)", *CLAIM_VIEWS, "v_entities"))
def exists_visible_claim(spark, d):
    seen = visibility.visible_claims(b.claims(spark, d), access_of(spark, d), READER).filter("status = 'active'")
    return visibility.has_claims(b.entities(spark, d), seen).select("id")


@query("op_j4", sql("SELECT e.id FROM v_entities e WHERE NOT EXISTS (SELECT 1 FROM v_claims c WHERE c.entity_id = e.id)", "v_claims", "v_entities"))
def without_claims(spark, d):
    return visibility.without_claims(b.entities(spark, d), b.claims(spark, d)).select("id")


@query("op_f27", sql("SELECT e.id, e.name FROM v_entities e WHERE e.id IN (SELECT entity_id FROM v_claims)", "v_claims", "v_entities"))
def claims_probe(spark, d):
    return visibility.has_claims(b.entities(spark, d), b.claims(spark, d)).select("id", "name")


@query("op_a8", sql("SELECT count(*) AS total, count(*) FILTER (WHERE access_level IN ('public', 'channel')) AS visible, count(*) FILTER (WHERE access_level NOT IN ('public', 'channel')) AS hidden FROM v_events", "v_events"))
def hidden_rows(spark, d):
    return visibility.hidden_count(b.events(spark, d), F.col("access_level").isin(*READER.levels))


@query("op_a4", sql(f"{ACCESS} SELECT c.entity_id, string_agg(c.predicate || ': ' || c.value, '; ' ORDER BY c.observed_at DESC, c.id DESC) AS claims, count(*) AS n_claims FROM v_claims c JOIN access a ON a.claim_id = c.id WHERE a.max_tier_rank <= 1 AND c.status = 'active' GROUP BY c.entity_id", *CLAIM_VIEWS))
def claim_text(spark, d):
    """Visible claims of each entity, newest first."""
    seen = visibility.visible_claims(b.claims(spark, d), access_of(spark, d), READER).filter("status = 'active'")
    text = F.concat(F.col("predicate"), F.lit(": "), F.col("value"))
    return seen.groupBy("entity_id").agg(listing.ordered_text(text, -F.unix_micros("observed_at"), -F.col("id")).alias("claims"), F.count("*").alias("n_claims"))


@query("op_x1", sql(f"SELECT id, {RANK.format('access_level')} AS rank, access_level AS level FROM v_events", "v_events"))
def rank_round_trip(spark, d):
    return b.events(spark, d).select("id", tier_rank("access_level").alias("rank")).withColumn("level", rank_to_level("rank"))


@query("op_y3", sql(f"SELECT access_level, {RANK.format('access_level')} AS r, count(*) AS n FROM v_events GROUP BY access_level", "v_events"))
def sql_functions(spark, d):
    register_sql_functions(spark)
    return b.events(spark, d).groupBy("access_level").agg(F.count("*").alias("n")).selectExpr("rank_to_level(tier_rank(access_level)) AS access_level", "tier_rank(access_level) AS r", "n")


@query("op_f25", sql("SELECT id, entity_id, status FROM v_claims WHERE entity_id = 'c:7'", "v_claims"))
def unfiltered_reader(spark, d):
    return b.claims(spark, d).filter("entity_id = 'c:7'").select("id", "entity_id", "status")
