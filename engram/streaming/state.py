"""What streams with keyed state need of a session.

With timers by the clock a stream always has another batch to look after, so
it needs a trigger by time. Run to the end of what is there (`availableNow`),
it ends only with `spark.sql.streaming.noDataMicroBatches.enabled` off; timers
that are due then fire in the next batch with rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keep state on disk, not on the heap: maps, lists, timers and expiry need it. A stream that was started before keeps what it has."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
