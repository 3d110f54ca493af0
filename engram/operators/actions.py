"""Actions on the graph by consolidation and enrichment passes: their effect, and their reversal.

An action is a row (action_id, action, entity_id, params map<string,string>,
children array<string>). Entities are rows (id, entity_type, name, description,
is_deleted, properties map<string,string>, part_of). Every effect is one
rewrite of a table; an action that can't be applied changes nothing and keeps
the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_date

#: Actions that change the one entity they name.
ON_ONE = ("remove_noise", "reclassify", "rewrite", "update_type", "update_status", "add_assignee")
CONFIDENCE = 0.9


def param(name: str) -> Column:
    return F.try_element_at("params", F.lit(name))


def sound(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """Actions whose every id names a live entity: the entity of an action on one, the children of a cluster, both ends of a link."""
    live = entities.filter("not is_deleted").select("id")
    ends = F.array(param("source_id"), param("target_id"))
    one = F.col("action").isin(*ON_ONE, "add_claim", "normalize_date")
    named = F.when(F.col("action") == "create_from_cluster", F.coalesce("children", F.array().cast("array<string>"))).when(F.col("action").isin("link_cross_type", "add_relation"), ends).when(one, F.array("entity_id"))
    ids = actions.filter(named.isNotNull()).select("action_id", F.explode(named).alias("id"))
    bad = ids.join(live, "id", "left_anti").select("action_id").distinct()
    return actions.filter(named.isNotNull()).join(bad, "action_id", "left_anti")


def snapshot(actions: DataFrame, entities: DataFrame) -> DataFrame:
    """(action_id, action, id, old_*, new_*): what an action on one entity found and left, enough to undo it. The last action (by action_id) on an entity counts."""
    latest = actions.filter(F.col("action").isin(*ON_ONE)).groupBy(F.col("entity_id").alias("id")).agg(F.max_by(F.struct("action_id", "action", "params"), "action_id").alias("a")).select("id", "a.*")
    x = latest.join(entities, "id")
    is_ = lambda *names: F.col("action").isin(*names)
    kept = lambda change, key: F.map_concat(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(F.lit(key), change))
    new = {
        "is_deleted": F.when(is_("remove_noise"), True).otherwise(F.col("is_deleted")),
        "entity_type": F.when(is_("reclassify", "update_type"), F.coalesce(param("type"), "entity_type")).otherwise(F.col("entity_type")),
        "name": F.when(is_("rewrite"), F.coalesce(param("name"), "name")).otherwise(F.col("name")),
        "description": F.when(is_("rewrite"), F.coalesce(param("description"), "description")).otherwise(F.col("description")),
        "properties": F.when(is_("update_status") & param("status").isNotNull(), kept(param("status"), "status")).when(is_("add_assignee") & param("assignee").isNotNull(), kept(param("assignee"), "assignee")).otherwise(F.col("properties")),
    }
    return x.select("action_id", "action", "id", *[F.col(c).alias(f"old_{c}") for c in new], *[v.alias(f"new_{c}") for c, v in new.items()])


CHANGED = ("is_deleted", "entity_type", "name", "description", "properties")


def apply_to_entities(entities: DataFrame, actions: DataFrame) -> DataFrame:
    """`entities` after actions on single ones and clusters: a cluster is a new entity ("cluster:" and its action_id), and its children become parts of it."""
    shot = snapshot(actions, entities).select("id", F.lit(True).alias("__hit"), *[f"new_{c}" for c in CHANGED])
    clusters = actions.filter("action = 'create_from_cluster'").select(F.concat(F.lit("cluster:"), "action_id").alias("__parent"), "params", "children")
    parents = clusters.select(F.explode("children").alias("id"), "__parent").groupBy("id").agg(F.min("__parent").alias("__parent"))
    out = entities.join(shot, "id", "left").join(parents, "id", "left")
    out = out.withColumns({c: F.when(F.col("__hit"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in CHANGED}).withColumn("part_of", F.coalesce("__parent", "part_of")).select(entities.columns)
    none = {"description": "string", "properties": "map<string,string>", "part_of": "string"}
    made = clusters.select(F.col("__parent").alias("id"), F.coalesce(param("type"), F.lit("topic")).alias("entity_type"), F.coalesce(param("name"), "__parent").alias("name"), F.lit(False).alias("is_deleted"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])
    return out.unionByName(made.select([F.col(c) if c in made.columns else F.lit(None).cast(t).alias(c) for c, t in entities.dtypes]))


def new_relations(actions: DataFrame) -> DataFrame:
    """(source_id, target_id, relation_type, confidence) of links and added relations, each once; no entity links to itself."""
    rows = actions.filter("action in ('link_cross_type', 'add_relation')").select(param("source_id").alias("source_id"), param("target_id").alias("target_id"), F.coalesce(param("relation_type"), F.lit("related_to")).alias("relation_type"), F.lit(CONFIDENCE).alias("confidence"))
    return rows.filter("source_id <> target_id").distinct()


def new_claims(actions: DataFrame, anchor: Column) -> DataFrame:
    """(action_id, entity_id, predicate, value, reason) of added claims and normalised dates; a date that can't be read keeps its text and has a reason."""
    date = iso_date(param("value"), anchor)
    rows = actions.filter("action in ('add_claim', 'normalize_date')").withColumn("__d", F.when(F.col("action") == "normalize_date", date))
    return rows.select("action_id", "entity_id", F.coalesce(param("predicate"), F.lit("description")).alias("predicate"), F.coalesce("__d.iso", param("value")).alias("value"), F.col("__d.reason").alias("reason"))


def roll_back_actions(entities: DataFrame, undo: DataFrame, force: bool = False) -> DataFrame:
    """`entities` with the values back that `undo` (rows of `snapshot`) found, and `conflict` where a later edit stands in the way.

    An action conflicts if a value that it changed is not what it left; then
    nothing of it is undone unless `force`. Deleted noise always comes back.
    Undoing twice changes nothing and is no conflict.
    """
    differs = lambda a, b: ~F.to_json(a).eqNullSafe(F.to_json(b)) if a._jc.toString().endswith("properties") else ~a.eqNullSafe(b)
    changed = lambda c: differs(F.col(f"old_{c}"), F.col(f"new_{c}"))
    edited = lambda c: changed(c) & differs(F.col(c), F.col(f"new_{c}")) & differs(F.col(c), F.col(f"old_{c}"))
    x = entities.join(undo, "id", "left")
    conflict = F.lit(False)
    for c in CHANGED[1:]:
        conflict = conflict | edited(c)
    x = x.withColumn("conflict", F.coalesce(F.col("action_id").isNotNull() & (F.col("action") != "remove_noise") & conflict, F.lit(False)))
    back = F.col("action_id").isNotNull() & (~F.col("conflict") | F.lit(force))
    return x.withColumns({c: F.when(back & changed(c), F.col(f"old_{c}")).otherwise(F.col(c)) for c in CHANGED}).select(*entities.columns, "conflict")


def moved_by(merges: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(action_id, row_id, held, loser, winner): references in `columns` of `df` that merges (action_id, loser, winner) repoint, recorded before them."""
    return _references(df, key, columns).withColumnRenamed("holder", "loser").join(merges.select("action_id", "loser", "winner"), "loser").select("action_id", "row_id", "held", "loser", "winner")


def _references(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(row_id, held, holder): a row for each reference."""
    held = F.explode(F.array(*[F.struct(F.lit(c).alias("held"), F.col(c).alias("holder")) for c in columns]))
    return df.select(F.col(key).alias("row_id"), held.alias("x")).select("row_id", "x.*")


def standing(moved: DataFrame, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`moved` with `state`, from who holds each reference now: winner (goes back), loser (is back), gone (no such row), other (a conflict)."""
    now = _references(df, key, columns).withColumn("there", F.lit(True))
    state = F.when(F.col("there").isNull(), "gone").when(F.col("holder") == F.col("winner"), "winner").when(F.col("holder") == F.col("loser"), "loser").otherwise("other")
    return moved.join(now, ["row_id", "held"], "left").withColumn("state", state).drop("holder", "there")


def conflicts(*standings: DataFrame) -> DataFrame:
    """(action_id): merges with a reference that someone else holds now, in any table."""
    found = [s.filter("state = 'other'").select("action_id") for s in standings]
    return reduce(DataFrame.union, found).distinct()


def move_back(df: DataFrame, stands: DataFrame, blocked: DataFrame, key: str, columns: list[str], force: bool = False) -> DataFrame:
    """`df` with references back at the losers. Of a blocked merge nothing moves, unless `force`; then all but the conflicts do. Doing it twice changes nothing."""
    undo = stands.filter("state = 'winner'")
    undo = undo if force else undo.join(blocked, "action_id", "left_anti")
    back = undo.groupBy("row_id").agg(*[F.max(F.when(F.col("held") == c, F.col("loser"))).alias(f"__{c}") for c in columns])
    joined = df.join(back, F.col(key) == F.col("row_id"), "left")
    return joined.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(df.columns)


def restore_losers(entities: DataFrame, merges: DataFrame, blocked: DataFrame, force: bool = False) -> DataFrame:
    """`entities` (..., name, is_deleted, merged_into, aliases) with the losers of undone merges alive, and their names off the winners' aliases.

    A loser that has been merged into another since stays as it is.
    """
    undone = merges if force else merges.join(blocked, "action_id", "left_anti")
    held = entities.select(F.col("id").alias("loser"), F.col("merged_into").alias("winner"), F.col("name").alias("__name"))
    undone = undone.select("loser", "winner").join(held, ["loser", "winner"]).distinct()
    names = undone.groupBy(F.col("winner").alias("id")).agg(F.collect_set("__name").alias("__names"))
    out = entities.join(undone.select(F.col("loser").alias("id"), F.lit(True).alias("__back")).distinct(), "id", "left").join(names, "id", "left")
    alive = F.coalesce("__back", F.lit(False))
    return out.withColumns({"is_deleted": F.col("is_deleted") & ~alive, "merged_into": F.when(~alive, F.col("merged_into")), "aliases": F.when(F.col("__names").isNotNull(), F.array_except("aliases", "__names")).otherwise(F.col("aliases"))}).select(entities.columns)


def roll_back_clusters(entities: DataFrame, undone: DataFrame, found: DataFrame) -> DataFrame:
    """`entities` without the clusters of `undone` (action_id): the made entity is soft-deleted, and what is still a part of it gets the parent of `found` (id, part_of) back."""
    ids = undone.select(F.concat(F.lit("cluster:"), "action_id").alias("__cluster")).distinct()
    parts = entities.join(ids.withColumnRenamed("__cluster", "part_of"), "part_of", "left_semi").select("id").join(found.select("id", F.col("part_of").alias("__was")), "id", "left").withColumn("__part", F.lit(True))
    out = entities.join(ids.select(F.col("__cluster").alias("id"), F.lit(True).alias("__made")), "id", "left").join(parts, "id", "left")
    return out.withColumns({"is_deleted": F.col("is_deleted") | F.coalesce("__made", F.lit(False)), "part_of": F.when(F.col("__part"), F.col("__was")).otherwise(F.col("part_of"))}).select(entities.columns)


def roll_back_links(relations: DataFrame, made: DataFrame, undone: DataFrame) -> DataFrame:
    """`relations` without those that only `undone` (action_id) made; `made` is (action_id, id), a relation may have several actions."""
    kept = made.join(undone.select("action_id"), "action_id", "left_anti").select("id")
    gone = made.join(undone.select("action_id"), "action_id", "left_semi").select("id").join(kept, "id", "left_anti").distinct()
    return relations.join(gone, "id", "left_anti")
