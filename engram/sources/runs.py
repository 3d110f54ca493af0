"""Keyed tables that take changes as further runs and merge them when they are read.

A table is a folder of runs. Run n is Parquet, dealt to buckets of the leading
key and sorted by the keys; the folder `run=a-b` holds the changes a to b, and
the widest folders over a change count. `merge` folds rows of equal keys, in the
order of their runs (column `run`), and is associative, so that neighbouring
runs can be folded ahead of time.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 32


class Runs:
    """`columns`: DDL of a row, the keys included. `buckets` is fixed for the life of a table."""

    def __init__(self, spark: SparkSession, path: str, columns: str, keys: list[str], merge: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.merge, self.buckets = spark, path.rstrip("/"), keys, merge, buckets
        self.schema = spark.createDataFrame([], columns).schema

    def _path(self, *name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *name]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def folders(self) -> list[tuple[int, int]]:
        """All finished runs, those that a wider one covers too."""
        if not self._fs.exists(self._path()):
            return []
        names = [re.fullmatch(r"run=(\d+)-(\d+)", s.getPath().getName()) for s in self._fs.listStatus(self._path())]
        return sorted((int(m[1]), int(m[2])) for m in names if m and self._fs.exists(self._path(m[0], "_SUCCESS")))

    def live(self, before: int | None = None) -> list[tuple[int, int]]:
        """The runs that count, ascending; those before a change only."""
        all_ = [r for r in self.folders() if before is None or r[1] < before]
        return [r for r in all_ if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in all_)]

    def bytes_of(self, run: tuple[int, int]) -> int:
        return self._fs.getContentSummary(self._path("run={}-{}".format(*run))).getLength()

    def _stored(self, runs: list[tuple[int, int]]) -> DataFrame:
        typed = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        read = lambda r: self.spark.read.schema(typed).parquet(f"{self.path}/run={r[0]}-{r[1]}").withColumn("run", F.lit(r[1]).cast("bigint"))
        return reduce(DataFrame.unionByName, map(read, runs)) if runs else self.spark.createDataFrame([], typed).withColumn("run", F.lit(0).cast("bigint"))

    def read(self, touching: DataFrame | None = None, before: int | None = None) -> DataFrame:
        """Merged rows. `touching` (a column of leading keys) names the rows asked for: only their buckets are read.

        What goes to the driver is the set of these buckets, `buckets` numbers at most.
        """
        rows = self._stored(self.live(before))
        if touching is not None:
            wanted = touching.select(F.col(touching.columns[0]).alias(self.keys[0])).distinct()
            hit = [r.b for r in wanted.select(self._bucket(F.col(self.keys[0])).alias("b")).distinct().collect()]
            rows = rows.filter(F.col("bucket").isin(hit)).join(wanted, self.keys[0], "left_semi")
        return self.merge(rows.drop("bucket")).select(*self.schema.names)

    def _write(self, df: DataFrame, name: str) -> None:
        """A bucket is one file, or several where it is large; small buckets share a task."""
        dealt = df.select(*self.schema.names).withColumn("bucket", self._bucket(F.col(self.keys[0])))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}")

    def add(self, df: DataFrame, n: int) -> None:
        """Write change n, once more if a writer was lost on it, after runs before it were folded.

        A change is folded with others only when the next one comes, so a
        replay of change n finds the same table before it.
        """
        self.fold(n)
        self._write(df, f"run={n}-{n}")

    def fold(self, before: int) -> None:
        """Fold the newest run into the one before it while that one isn't more than twice its size; drop runs that are covered.

        A row is so written again once for each doubling of its run, never once for each change.
        """
        runs = self.live(before)
        covered = [r for r in self.folders() if r[1] < before and r not in runs]
        while len(runs) > 1 and self.bytes_of(runs[-2]) <= 2 * self.bytes_of(runs[-1]):
            wide = (runs[-2][0], runs[-1][1])
            self._write(self.merge(self._stored(runs[-2:]).drop("bucket")), "run={}-{}".format(*wide))
            runs = [*runs[:-2], wide]
        for r in covered:  # those covered just now go with the next change: readers may have them open
            self._fs.delete(self._path("run={}-{}".format(*r)), True)


def summed(keys: list[str], n: str = "n") -> Callable[[DataFrame], DataFrame]:
    """A merge that adds up signed counts; keys that come to nothing go."""
    return lambda rows: rows.groupBy(*keys).agg(F.sum(n).alias(n)).filter(F.col(n) != 0)


def newest(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A merge that keeps the row of the latest run."""
    w = Window.partitionBy(*keys).orderBy(F.desc("run"))
    return lambda rows: rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
