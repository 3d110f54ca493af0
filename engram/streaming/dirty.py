"""Event-driven consolidation: changed ids collect per tenant and fire by number or by age.

A tenant fires when `least` distinct ids have changed, or when the first of
them is `max_age` old by processing time; firing drains the set. Ids are the
keys of a map in the state store, the age is a timer, and a drained set comes
out a row for each id, so no task holds a tenant's set in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from .state import keyed_state

LEAST = 10
MAX_AGE_SECONDS = 1800
TTL_HOURS = 48
#: Ids that a task remembers, so as not to ask the state store about each repeat.
REMEMBERED = 100_000


class Drain(StatefulProcessor):
    """A tenant's set: `ids` (map, each id with an expiry of its own) and `since` (when its first id came, which is its timer)."""

    def __init__(self, least: int, max_age_seconds: float, ttl_hours: float):
        self.least, self.max_age, self.ttl = least, int(max_age_seconds * 1000), int(ttl_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id bigint", "seen boolean", ttlDurationMs=self.ttl)
        self.since = handle.getValueState("since", "at bigint")

    def _keep(self, ids: set[int]) -> None:
        for i in ids:
            self.ids.updateValue((i,), (True,))

    def _drain(self, ws: int, now: int, reason: str, ids: set[int] | None = None) -> Iterator[Row]:
        """A row for each of `ids`, or of the state's, which is cleared."""
        at = datetime.fromtimestamp(now / 1000, timezone.utc)
        for i in (i for (i,) in self.ids.keys()) if ids is None else ids:
            yield Row(ws=ws, id=i, reason=reason, fired_at=at)
        self.ids.clear()
        self.since.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        before = {i for (i,) in self.ids.keys()}  # fewer than `least`: a larger set was drained
        n, timed = len(before), self.since.exists()
        if n == 0 and timed:  # all of them expired
            self.handle.deleteTimer(self.since.get()[0] + self.max_age)
            self.since.clear()
            timed = False
        lately, whole = set(), True  # the state is asked and told only of a set that stays, or that is too large for a task
        for row in rows:
            if row.id in lately:
                continue
            n += row.id not in before and (whole or not self.ids.containsKey((row.id,)))
            lately.add(row.id)
            if len(lately) == REMEMBERED:
                self._keep(lately)
                lately, whole = set(), False
        if n < self.least or not whole:
            self._keep(lately)
        if n >= self.least:
            if timed:
                self.handle.deleteTimer(self.since.get()[0] + self.max_age)
            if whole and not timed:  # nothing of it is in the state
                at = datetime.fromtimestamp(now / 1000, timezone.utc)
                for i in lately:
                    yield Row(ws=key[0], id=i, reason="count", fired_at=at)
            else:
                yield from self._drain(key[0], now, "count", before | lately if whole else None)
        elif not timed:  # the clock starts with the first change and is not set again
            self.since.update((now,))
            self.handle.registerTimer(now + self.max_age)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._drain(key[0], timerValues.getCurrentProcessingTimeInMs(), "age")

    def close(self) -> None:
        pass


def _once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        yield pdf.drop_duplicates()


def drained(changes: DataFrame, least: int = LEAST, max_age_seconds: float = MAX_AGE_SECONDS, ttl_hours: float = TTL_HOURS) -> DataFrame:
    """(ws, id, reason, fired_at) from a stream of (ws, id): reason is `count` or `age`; rows of one ws and fired_at are one set. Nulls are left out.

    An id that isn't named again and isn't drained goes after `ttl_hours`. Repeats
    in a block of rows go before the shuffle.
    """
    keyed_state(changes.sparkSession)
    clean = changes.filter("ws is not null and id is not null").select(F.col("ws").cast("bigint"), F.col("id").cast("bigint")).mapInPandas(_once, "ws bigint, id bigint")
    return clean.groupBy("ws").transformWithState(Drain(least, max_age_seconds, ttl_hours), "ws bigint, id bigint, reason string, fired_at timestamp", "append", "ProcessingTime")


def with_recent(drained_sets: DataFrame, rows: DataFrame, as_of: datetime, hours: int = 48) -> DataFrame:
    """(ws, id), each once: drained ids and, of the tenants that fired, the rows (ws, id, updated_at) changed in the last `hours`."""
    recent = rows.filter(F.col("updated_at") >= F.lit(as_of) - F.make_dt_interval(hours=F.lit(hours))).join(drained_sets.select("ws").distinct(), "ws", "left_semi")
    return drained_sets.select("ws", "id").union(recent.select("ws", "id")).distinct()


def consolidate(drained_sets: DataFrame, load: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, hours: int = 48) -> DataStreamWriter:
    """A writer that gives `handle` (ids of a micro-batch with those of `load()` that changed lately, batch id); a replayed batch id means the same drained sets."""

    def run(batch: DataFrame, batch_id: int) -> None:
        now = batch.sparkSession.sql("SELECT now()").first()[0]
        handle(with_recent(batch, load(), now, hours), batch_id)

    return drained_sets.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
