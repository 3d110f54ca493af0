"""Derived access levels kept up to date from changes, without reading what they don't touch.

Kept are counts in keyed tables: links (event, claim), the rank of each event,
the owner of each claim, and how many sources of each rank a claim has and how
many claims of each rank an entity has. A count that falls to nothing uncovers the
next lower rank, so a downgrade needs no look at the other sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.access import rank_to_level, tier_rank
from ..sources.runs import BUCKETS, Runs, newest, summed
from ..sources.storage import written
from .visibility import RESTRICTED


@dataclass
class Changed:
    """What a step changed: claims (claim_id, max_tier_rank) and entities (entity_id, max_tier_rank, access_level); null ranks are of rows that are gone or have no claims any more."""

    claims: DataFrame
    entities: DataFrame


def _highest(tiers: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the highest rank with a count above nothing."""
    return tiers.groupBy(key, "rank").agg(F.sum("n").alias("n")).filter("n > 0").groupBy(key).agg(F.max("rank").alias(name))


class Restamp:
    """The tables under `path`. Ids of claims and entities are strings or numbers as `claim_id` and `entity_id` say."""

    def __init__(self, spark: SparkSession, path: str, event_id: str = "bigint", claim_id: str = "bigint", entity_id: str = "string", buckets: int = BUCKETS):
        self.spark = spark
        table = lambda name, columns, keys, merge: Runs(spark, f"{path}/{name}", columns, keys, merge, buckets)
        self.links = table("links", f"event_id {event_id}, claim_id {claim_id}, n bigint", ["event_id", "claim_id"], summed(["event_id", "claim_id"]))
        self.ranks = table("ranks", f"event_id {event_id}, rank int", ["event_id"], newest(["event_id"]))
        self.owners = table("owners", f"claim_id {claim_id}, entity_id {entity_id}, n bigint", ["claim_id", "entity_id"], summed(["claim_id", "entity_id"]))
        self.sources = table("sources", f"claim_id {claim_id}, rank int, n bigint", ["claim_id", "rank"], summed(["claim_id", "rank"]))
        self.claims = table("claims", f"entity_id {entity_id}, rank int, n bigint", ["entity_id", "rank"], summed(["entity_id", "rank"]))

    def apply(self, n: int, events: DataFrame | None = None, links: DataFrame | None = None, claims: DataFrame | None = None) -> Changed:
        """Change number `n`, ascending from 0; the same number again replaces it.

        events (event_id, access_level): new levels, and null for events that are
        gone; one row for an event. links (claim_id, event_id, n) and claims
        (claim_id, entity_id, n): added where n is 1, taken away where it is -1. A
        link may come before its event or its claim. An unknown level is the
        strictest.
        """
        empty = lambda t: self.spark.createDataFrame([], t.schema)
        levels = empty(self.ranks) if events is None else written(events.select("event_id", F.when(F.col("access_level").isNotNull(), tier_rank("access_level")).cast("int").alias("rank")), "levels")
        new_links = empty(self.links) if links is None else written(links.select("event_id", "claim_id", F.col("n").cast("bigint").alias("n")), "links")
        new_owners = empty(self.owners) if claims is None else written(claims.select("claim_id", "entity_id", F.col("n").cast("bigint").alias("n")), "owners")

        touched = levels.select("event_id").union(new_links.select("event_id")).distinct()
        before = self.ranks.read(touched, n).withColumnRenamed("rank", "old")
        moved = before.join(levels.withColumn("fresh", F.lit(True)), "event_id", "full")
        moved = written(moved.select("event_id", "old", F.when(F.col("fresh"), F.col("rank")).otherwise(F.col("old")).alias("new"), F.coalesce("fresh", F.lit(False)).alias("fresh")), "moved")
        held = self.links.read(levels.select("event_id"), n).join(moved.filter("fresh and not (old <=> new)"), "event_id")
        shift = held.select("claim_id", F.explode(F.array(F.struct(F.col("old").alias("rank"), (-F.col("n")).alias("n")), F.struct(F.col("new").alias("rank"), F.col("n").alias("n")))).alias("x")).select("claim_id", "x.rank", "x.n")
        added = new_links.join(moved, "event_id").select("claim_id", F.col("new").alias("rank"), "n")
        sources = shift.unionByName(added).filter("rank is not null").groupBy("claim_id", "rank").agg(F.sum("n").alias("n")).filter("n <> 0")
        sources = written(sources, "sources")

        ids = sources.select("claim_id").union(new_owners.select("claim_id")).distinct()
        stood = self.sources.read(ids, n)
        old, new = _highest(stood, "claim_id", "old"), _highest(stood.unionByName(sources), "claim_id", "new")
        owned = self.owners.read(ids, n).withColumn("was", F.lit(True)).unionByName(new_owners.withColumn("was", F.lit(False)))
        owned = owned.groupBy("claim_id", "entity_id").agg(F.coalesce(F.sum(F.when(F.col("was"), F.col("n"))), F.lit(0)).alias("was"), F.sum("n").alias("is"))
        both = owned.join(old, "claim_id", "left").join(new, "claim_id", "left")
        rank = lambda c, there: F.when(F.col(there) > 0, F.coalesce(c, F.lit(RESTRICTED)))
        both = both.select("claim_id", "entity_id", rank("old", "was").alias("old"), rank("new", "is").alias("new")).filter("not (old <=> new)")
        both = written(both, "claims")
        of_entity = both.select("entity_id", F.explode(F.array(F.struct(F.col("old").alias("rank"), F.lit(-1).cast("bigint").alias("n")), F.struct(F.col("new").alias("rank"), F.lit(1).cast("bigint").alias("n")))).alias("x"))
        of_entity = written(of_entity.select("entity_id", "x.rank", "x.n").filter("rank is not null").groupBy("entity_id", "rank").agg(F.sum("n").alias("n")).filter("n <> 0"), "entities")

        had = self.claims.read(of_entity.select("entity_id"), n)
        change = of_entity.select("entity_id").distinct().join(_highest(had, "entity_id", "old"), "entity_id", "left").join(_highest(had.unionByName(of_entity), "entity_id", "new"), "entity_id", "left")
        change = written(change.filter("not (old <=> new)").select("entity_id", F.col("new").alias("max_tier_rank"), rank_to_level("new").alias("access_level")), "changed")

        self.ranks.add(levels, n)
        self.links.add(new_links, n)
        self.owners.add(new_owners, n)
        self.sources.add(sources, n)
        self.claims.add(of_entity, n)
        return Changed(both.groupBy("claim_id").agg(F.max("new").alias("max_tier_rank")), change)

    def claim_access(self) -> DataFrame:
        """(claim_id, max_tier_rank) of all claims, as `visibility.effective_access` gives it."""
        known = self.owners.read().select("claim_id").distinct()
        return known.join(_highest(self.sources.read(), "claim_id", "max_tier_rank"), "claim_id", "left").withColumn("max_tier_rank", F.coalesce("max_tier_rank", F.lit(RESTRICTED)))

    def entity_access(self) -> DataFrame:
        """(entity_id, max_tier_rank, access_level) of all entities with claims."""
        return _highest(self.claims.read(), "entity_id", "max_tier_rank").withColumn("access_level", rank_to_level("max_tier_rank"))
