"""Idempotent event upserts from a stream, merged on read.

Each micro-batch writes its own rows as one run of a keyed table and no row of
the others; a reader folds the runs, and runs of like size are folded ahead of
time. A replayed batch writes the same run again, so replays change nothing.
Late rows are kept: no watermark drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.access import rank_to_level, tier_rank
from ..sources.runs import BUCKETS, Runs

KEYS = ["source_type", "source_id"]


def upserted(payload: list[str], at: str = "run") -> Callable[[DataFrame], DataFrame]:
    """A merge of rows of one event, in the order of `at`: later values win where given, and an access level only ever tightens."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c)
    return lambda rows: rows.groupBy(*KEYS).agg(*[last(c) for c in payload], F.max(tier_rank("access_level")).alias("__rank")).withColumn("access_level", rank_to_level("__rank")).drop("__rank")


def event_table(spark: SparkSession, path: str, payload: dict[str, str], buckets: int = BUCKETS) -> Runs:
    """Events under `path`, keyed by (source_id, source_type); `payload`: name to type."""
    columns = ", ".join(["source_type string", "source_id string", *[f"`{c}` {t}" for c, t in payload.items()], "access_level string"])
    return Runs(spark, path, columns, ["source_id", "source_type"], upserted(list(payload)), buckets)


def of_batch(rows: DataFrame, payload: list[str]) -> DataFrame:
    """One row for each key of a batch: the last by `seq` counts, whole; ties go by the values."""
    kept = F.max(F.struct("seq", "access_level", *payload)).alias("__last")
    return rows.groupBy(*KEYS).agg(kept).select(*KEYS, "__last.access_level", *[F.col(f"__last.{c}") for c in payload])


def current(spark: SparkSession, path: str, payload: dict[str, str]) -> DataFrame:
    """The table as of the last finished batch."""
    return event_table(spark, path, payload).read()


def upsert_stream(events: DataFrame, path: str, checkpoint: str, payload: dict[str, str], buckets: int = BUCKETS) -> DataStreamWriter:
    """A writer that merges (source_type, source_id, access_level, seq, *payload) into the table under `path`; of one batch's rows for a key the last `seq` counts."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        event_table(batch.sparkSession, path, payload, buckets).add(of_batch(batch, list(payload)), batch_id)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
