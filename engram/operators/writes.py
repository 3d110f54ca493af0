"""Copy-on-write updates: upserts, replacements, allow-listed updates, claim supersession."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.access import rank_to_level, tier_rank


def upsert_events(current: DataFrame, incoming: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """One row for each key: incoming values win where given, and an access level only ever tightens. `inserted` marks new keys."""
    old = current.select(*keys, *[F.col(c).alias(f"old_{c}") for c in [*payload, "access_level"]], F.lit(True).alias("__old"))
    new = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in [*payload, "access_level"]], F.lit(True).alias("__new"))
    both = old.join(new, keys, "full")
    rank = F.greatest(F.when(F.col("__old"), tier_rank("old_access_level")), F.when(F.col("__new"), tier_rank("new_access_level")))
    return both.select(*keys, *[F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in payload], rank_to_level(rank).alias("access_level"), F.col("__old").isNull().alias("inserted"))


def insert_if_absent(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return current.unionByName(incoming.join(current.select(*keys), keys, "left_anti").select(current.columns))


def replace_by_source(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Every row of an incoming source replaces all rows of that source."""
    return current.join(incoming.select(*keys).distinct(), keys, "left_anti").select(current.columns).unionByName(incoming.select(current.columns))


def update_allowed(current: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """`current` with the non-null values of `changes` in the allowed columns; other columns of `changes` are ignored."""
    cols = [c for c in allowed if c in changes.columns and c in current.columns]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in cols])
    return current.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in cols}).select(current.columns)


def next_status(status: Column, wanted: Column, terminal: tuple[str, ...] = ("completed", "failed")) -> Column:
    """A status machine in which a terminal state stays."""
    return F.when(status.isin(*terminal), status).otherwise(wanted)


def latest_wins(claims: DataFrame, keys: list[str]) -> DataFrame:
    """`claims` with state, valid_to and superseded_by after replaying arrivals (`seq`) under the rule "newer or equal supersedes".

    `keys` name the entity and the predicate. Only claims of status "active"
    take part; others keep their status as state. A claim is a record when none
    that arrived before was observed later. A record is displaced by the next
    record; any other claim by the record that held when it arrived. Late claims
    are kept as history.
    """
    c = claims.withColumn("__live", F.coalesce(F.col("status") == "active", F.lit(False)))
    arrival = Window.partitionBy(*keys, "__live").orderBy("seq")
    so_far = arrival.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = F.max(F.struct("observed_at", "seq", "id")).over(so_far)
    c = c.withColumn("__best", best).withColumn("__record", F.col("__best.seq") == F.col("seq"))
    among = Window.partitionBy(*keys, "__live", "__record").orderBy("seq")
    following = F.lead(F.struct("observed_at", "seq", "id")).over(among)
    c = c.withColumn("__next", F.when(F.col("__live"), F.when(F.col("__record"), following).otherwise(F.col("__best"))))
    state = F.when(~F.col("__live"), F.col("status")).when(F.col("__next").isNull(), "active").otherwise("superseded")
    return c.withColumns({"state": state, "valid_to": F.col("__next.observed_at"), "superseded_by": F.col("__next.id")}).drop("__live", "__best", "__record", "__next")


def accumulate(claims: DataFrame, keys: list[str]) -> DataFrame:
    """The first arrival of every distinct value; repeats of an active value are skipped."""
    w = Window.partitionBy(*keys, "value").orderBy("seq")
    return claims.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _by_key(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole keys from batches that are sorted by key; a key may span batches."""
    held: pd.DataFrame | None = None
    for pdf in frames:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        last = (pdf[keys].fillna("").astype(str) == pdf[keys].fillna("").astype(str).iloc[-1]).all(axis=1)
        held = pdf[last]
        if not last.all():
            yield pdf[~last]
    if held is not None and not held.empty:
        yield held


def _explicit(ids: list, values: list, times: list, sure: list, status: list, least: float) -> tuple[list, list]:
    """States and successors of one key's claims in order of arrival."""
    state, by = list(status), [None] * len(ids)
    active: list[int] = []
    for i, (value, at, c) in enumerate(zip(values, times, sure, strict=True)):
        if status[i] != "active":
            continue
        for j in [j for j in active if values[j] != value]:
            if not (c >= least and at >= times[j]):
                state[i] = "disputed"
                break
            state[j], by[j] = "superseded", ids[i]
            active.remove(j)
        if state[i] == "active":
            active.append(i)
    return state, by


def explicit_only(claims: DataFrame, keys: list[str], least: float = 0.85) -> DataFrame:
    """An ordered fold of arrivals per key: a confident, not older, different value supersedes; a different value otherwise is disputed.

    The first dispute ends a claim's turn: it displaces no claim after that one.
    An equal value leaves both active. Only claims of status "active" take part;
    others keep their status as state. Keys are hash-partitioned and sorted by
    arrival, and a task folds its keys one after the other: the rule depends on
    every earlier outcome of a key, so one key's claims are held together.
    """
    cols = claims.columns

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _by_key(frames, keys):
            group = pdf[keys].fillna("").astype(str).agg("\x00".join, axis=1).to_numpy()
            ids, values, times, sure, status = (pdf[c].tolist() for c in ("id", "value", "observed_at", "confidence", "status"))
            cuts = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            parts = [_explicit(ids[a:b], values[a:b], times[a:b], sure[a:b], status[a:b], least) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pdf.assign(state=[x for p in parts for x in p[0]], superseded_by=pd.array([x for p in parts for x in p[1]], dtype="Int64"))

    schema = T.StructType([*claims.schema.fields, T.StructField("state", T.StringType()), T.StructField("superseded_by", T.LongType())])
    return claims.repartition(*keys).sortWithinPartitions(*keys, "seq").select(cols).mapInPandas(fold, schema)


def claim_value(raw: Column, kind: Column) -> Column:
    """A claim's value as canonical JSON, by value type; a number that can't be parsed is text."""
    number = raw.try_cast("double")
    as_text = F.to_json(F.struct(raw.alias("text")))
    return (
        F.when(kind == "number", F.when(number.isNull(), as_text).otherwise(F.to_json(F.struct(number.alias("number"), raw.alias("raw")))))
        .when(kind == "boolean", F.to_json(F.struct(F.lower(F.trim(raw)).isin("true", "1", "yes").alias("boolean"))))
        .when(kind == "entity_ref", F.to_json(F.struct(raw.alias("raw"))))
        .otherwise(as_text)
    )


def admit(kept: list[float], t: float, limit: int, window_seconds: float) -> tuple[bool, float | None]:
    """Whether a request at `t` is admitted, and else the seconds to wait; `kept`, the admitted ones of the window in order, is brought up to date."""
    kept[:] = [x for x in kept if x > t - window_seconds]
    if len(kept) < limit:
        kept.append(t)
        return True, None
    return False, (min(kept) if kept else t) + window_seconds - t


def rate_limited(requests: DataFrame, key: str, at: str, limit: int, window_seconds: float) -> DataFrame:
    """`requests` with `allowed` and `retry_after`: a sliding window that counts admitted requests only, replayed in order (`at` in seconds, then `seq`).

    retry_after: seconds until the oldest admitted request leaves the window; null if allowed.
    Keys are hash-partitioned and sorted; a task keeps one key's admitted
    requests of the window, `limit` of them at most.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[float] = []
        current = object()
        for pdf in frames:
            out, wait = [], []
            for k, t in zip(pdf[key].tolist(), pdf[at].tolist(), strict=True):
                if k != current:
                    current, kept = k, []
                allowed, seconds = admit(kept, t, limit, window_seconds)
                out.append(allowed)
                wait.append(seconds)
            yield pdf.assign(allowed=out, retry_after=pd.Series(wait, index=pdf.index, dtype="float64"))

    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("retry_after", T.DoubleType())])
    return requests.repartition(key).sortWithinPartitions(key, at, "seq").mapInPandas(fold, schema)
