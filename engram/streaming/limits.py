"""A sliding-window rate limiter over a stream of requests; `operators.writes.rate_limited` is its replay over a table."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.writes import admit
from .state import keyed_state

IDLE_SECONDS = 86_400


class Limiter(StatefulProcessor):
    """A key's state: the times of its admitted requests in the window, `limit` of them at most, and a timer that ends an idle key."""

    def __init__(self, limit: int, window_seconds: float, idle_seconds: float):
        self.limit, self.window, self.keep = limit, window_seconds, int((window_seconds + idle_seconds) * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "at double")
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [at for (at,) in self.admitted.get()]
        for at, seq in sorted((r.at, r.seq) for r in rows):
            allowed, wait = admit(kept, at, self.limit, self.window)
            yield Row(key=key[0], at=at, seq=seq, allowed=allowed, retry_after=wait)
        if kept:
            self.admitted.put([(at,) for at in kept])
        else:
            self.admitted.clear()
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
        until = timerValues.getCurrentProcessingTimeInMs() + self.keep
        self.until.update((until,))
        self.handle.registerTimer(until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.admitted.clear()
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_limited(requests: DataFrame, key: str, at: str, limit: int, window_seconds: float, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """(key, at, seq, allowed, retry_after) for every request (`key`, `at` in seconds, `seq`) of a stream, whatever batches it comes in.

    A batch's requests of a key are answered by (at, seq); a task holds two
    numbers for each of them. Requests that come in a later batch with an
    earlier time are answered when they come, none is dropped. A key without
    requests for the window and `idle_seconds` more is forgotten: decisions are
    those of the replay unless a stream stands still for longer. Requests
    without a time or key are left out.
    """
    keyed_state(requests.sparkSession)
    named = requests.select(F.col(key).alias("key"), F.col(at).cast("double").alias("at"), F.col("seq").cast("bigint").alias("seq")).filter("key is not null and at is not null")
    of_key = dict(named.dtypes)["key"]
    return named.groupBy("key").transformWithState(Limiter(limit, window_seconds, idle_seconds), f"key {of_key}, at double, seq bigint, allowed boolean, retry_after double", "append", "ProcessingTime")
