"""Consolidation passes: proposed actions, their validation and effect, and the loop to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_artifact_name
from ..sources.storage import written

MAX_PASSES = 3


def propose_noise(entities: DataFrame) -> DataFrame:
    """(action, id): the deterministic rule, artifact names are noise."""
    return entities.filter(~F.col("is_deleted") & is_artifact_name(F.col("name"))).select(F.lit("remove_noise").alias("action"), "id")


def valid_actions(actions: DataFrame, entities: DataFrame, children: str | None = None) -> DataFrame:
    """Actions whose id, and every id of an array column `children`, names a live entity."""
    live = entities.filter("not is_deleted").select("id")
    ok = actions.join(live, "id", "left_semi")
    if children is None:
        return ok
    named = ok.select("id", F.explode(children).alias("__child"))
    bad = named.join(live.withColumnRenamed("id", "__child"), "__child", "left_anti").select("id").distinct()
    return ok.join(bad, "id", "left_anti")


def apply_noise(entities: DataFrame, actions: DataFrame) -> DataFrame:
    gone = actions.filter("action = 'remove_noise'").select("id", F.lit(True).alias("__gone")).distinct()
    return entities.join(gone, "id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("__gone", F.lit(False))).select(entities.columns)


def signature(actions: DataFrame) -> str:
    """A hash of the set of actions, whatever its order; the same set again means a cycle."""
    row = actions.select(F.sha2(F.concat_ws("|", *actions.columns), 256).alias("h")).distinct().agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return f"{row.n}:{row.s}"


def snapshots(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes rows under ``spark.checkpoint.dir`` and reads them back; a session on one machine may leave it unset."""
    return lambda df: written(df, "pass")


def to_fixpoint(entities: DataFrame, propose: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame], passes: int = MAX_PASSES) -> tuple[DataFrame, str]:
    """Apply proposed actions until there are none, a set of them repeats, or `passes` have run.

    `keep` writes a pass's rows and reads them back, so each pass starts from a
    snapshot; a pass that fails leaves the one before it.
    """
    seen: set[str] = set()
    for _ in range(passes):
        actions = valid_actions(propose(entities), entities)
        now = signature(actions)
        if now.startswith("0:"):
            return entities, "no_actions"
        if now in seen:
            return entities, "cycle_detected"
        seen.add(now)
        entities = keep(apply(entities, actions))
    return entities, "max_passes"
