"""Tables that cut a job's lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join that is known to be smaller is sent to all executors; a larger one is shuffled.
BROADCAST_BYTES = 32 << 20
#: Input of one task of a shuffle, about.
TASK_BYTES = 128 << 20


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on one machine, as in tests, gets a fresh temporary folder where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="engram-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Parquet tables of one job in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/engram-{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str = "table") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write `df` and read it back: a lost executor repeats nothing that came before."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._engram_path = at
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more, and the shuffle files of finished jobs, which go with the driver's garbage."""
        for df in tables:
            self.delete(df._engram_path)
        self.spark._jvm.System.gc()

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df`, marked for broadcast if its counted rows fit; `df` must be cheap to count (a written table)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def tasks_for(df: DataFrame) -> int:
    """Partitions for a shuffle of `df`: the session's number, or more if Spark's estimate of its size asks for more."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    unknown = size >= 1 << 60
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 if unknown else ceil(size / TASK_BYTES))


class SortedRun:
    """A table in buckets by `key`, each in one file that is sorted by it: joins by key read it as it lies, without exchange or sort."""

    def __init__(self, scratch: Scratch, df: DataFrame, key: str, buckets: int, name: str = "run"):
        self.spark, self.scratch, self.at = scratch.spark, scratch, scratch.path(name)
        self.name = f"engram_{name}_{uuid.uuid4().hex}"
        dealt = df.repartition(buckets, key).sortWithinPartitions(key)
        dealt.write.bucketBy(buckets, key).sortBy(key).option("path", self.at).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        self.scratch.delete(self.at)


@contextmanager
def stored_order(spark: SparkSession) -> Iterator[None]:
    """Jobs that start here trust the order of the files of a `SortedRun`."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
