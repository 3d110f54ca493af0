"""Tenant and access filters, effective access of derived rows, and what a caller may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.access import LEVELS, Caller, rank_to_level, tier_rank

RESTRICTED = len(LEVELS) - 1


def of_workspace(df: DataFrame, caller: Caller) -> DataFrame:
    """The caller's tenant only; without one, nothing."""
    return df.filter(F.col("ws") == F.lit(caller.workspace))


def by_level(df: DataFrame, caller: Caller, column: str = "access_level") -> DataFrame:
    return df.filter(F.col(column).isin(*sorted(caller.levels)))


def by_rank(df: DataFrame, caller: Caller, column: str = "max_tier_rank") -> DataFrame:
    return df.filter(F.col(column) <= caller.max_rank)


def effective_access(claims: DataFrame, sources: DataFrame, events: DataFrame) -> DataFrame:
    """(claim_id, max_tier_rank): the strictest level of a claim's source events; a claim without one is restricted."""
    chain = claims.select(F.col("id").alias("claim_id")).join(sources, "claim_id", "left").join(events.select(F.col("id").alias("event_id"), tier_rank("access_level").alias("rank")), "event_id", "left")
    return chain.groupBy("claim_id").agg(F.coalesce(F.max("rank"), F.lit(RESTRICTED)).alias("max_tier_rank"))


def entity_access(claims: DataFrame, access: DataFrame) -> DataFrame:
    """(entity_id, max_tier_rank, access_level): the strictest of an entity's claims."""
    ranked = claims.join(access, claims.id == access.claim_id).groupBy("entity_id").agg(F.max("max_tier_rank").alias("max_tier_rank"))
    return ranked.withColumn("access_level", rank_to_level("max_tier_rank"))


def visible_claims(claims: DataFrame, access: DataFrame, caller: Caller) -> DataFrame:
    return claims.join(by_rank(access, caller), claims.id == access.claim_id).drop("claim_id")


def entity_flags(entities: DataFrame, claims: DataFrame, access: DataFrame, caller: Caller) -> DataFrame:
    """`entities` with has_claims and sees_claim (an active claim that the caller may see)."""
    seen = F.max(((F.col("status") == "active") & (F.col("max_tier_rank") <= caller.max_rank)).cast("int"))
    flags = claims.join(access, claims.id == access.claim_id).groupBy("entity_id").agg(seen.alias("seen"))
    return entities.join(flags, entities.id == flags.entity_id, "left").drop("entity_id").withColumn("has_claims", F.col("seen").isNotNull()).withColumn("sees_claim", F.coalesce("seen", F.lit(0)) == 1).drop("seen")


def visible_entities(entities: DataFrame, claims: DataFrame, access: DataFrame, caller: Caller) -> DataFrame:
    """Entities that the caller may see: all for an admin; else with a visible active claim, or without any claim."""
    flagged = entity_flags(entities, claims, access, caller)
    return flagged if caller.is_admin else flagged.filter("sees_claim or not has_claims")


def masked(entities: DataFrame, caller: Caller, columns: dict[str, str]) -> DataFrame:
    """Hide free-text columns of entities that have claims from callers without admin scope; `columns`: name to stand-in SQL."""
    if caller.is_admin:
        return entities
    return entities.withColumns({c: F.when(F.col("has_claims"), F.expr(instead)).otherwise(F.col(c)) for c, instead in columns.items()})


def visible_relations(relations: DataFrame, relation_sources: DataFrame, events: DataFrame, claims: DataFrame, access: DataFrame, caller: Caller) -> DataFrame:
    """Relations whose two ends have a visible active claim, and with a visible source; without sources, for an admin only."""
    seen = visible_claims(claims, access, caller).filter("status = 'active'").select("entity_id").distinct()
    ends = relations.join(seen.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(seen.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    ranks = relation_sources.join(events.select(F.col("id").alias("event_id"), tier_rank("access_level").alias("rank")), "event_id", "left")
    open_ = ranks.groupBy("relation_id").agg(F.max((F.coalesce("rank", F.lit(RESTRICTED)) <= caller.max_rank).cast("int")).alias("open"))
    joined = ends.join(open_, ends.id == open_.relation_id, "left")
    return joined.filter((F.col("open") == 1) | (F.col("open").isNull() & F.lit(caller.is_admin))).drop("relation_id", "open")


def hidden_count(df: DataFrame, visible) -> DataFrame:
    """(total, visible, hidden) in one pass; `visible` is a condition."""
    return df.agg(F.count("*").alias("total"), F.count_if(visible).alias("visible")).withColumn("hidden", F.greatest(F.col("total") - F.col("visible"), F.lit(0)))


def has_claims(entities: DataFrame, claims: DataFrame) -> DataFrame:
    return entities.join(claims, entities.id == claims.entity_id, "left_semi")


def without_claims(entities: DataFrame, claims: DataFrame) -> DataFrame:
    return entities.join(claims, entities.id == claims.entity_id, "left_anti")


def restamped(chunks: DataFrame, access: DataFrame, key: str) -> DataFrame:
    """`chunks` with their access level recomputed where `access` (key, rank) has their key; others keep theirs."""
    fresh = access.select(F.col(access.columns[0]).alias("__key"), rank_to_level(access.columns[1]).alias("__level"))
    return chunks.join(fresh, F.col(key) == F.col("__key"), "left").withColumn("access_level", F.coalesce("__level", "access_level")).drop("__key", "__level")
