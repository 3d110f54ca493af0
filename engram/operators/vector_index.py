"""An inverted file of vectors: exact nearest neighbours that read only the cells that can hold one.

Rows lie in Parquet files partitioned by cell and sorted by the angle to the
cell's centroid. A search probes the nearest cells until it has its hits, takes
the last hit's similarity, and adds every cell that could hold a better row by
the triangle inequality; the cells that it leaves out provably hold none, with
or without a filter. On vectors without structure in many dimensions no bound of
this kind leaves anything out, and a search reads all cells.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.similarity import cosine
from ..sources.storage import fresh
from . import cells as cl

#: Hits are ordered by similarity to this many decimals, then by `order`.
DIGITS = 6
_CELLS = "cell int, low double, high double, n bigint, centroid array<double>"


class VectorIndex:
    def __init__(self, rows: DataFrame, path: str, vector: str, extents: cl.Extents):
        self.rows, self.path, self.vector, self.extents = rows, path, vector, extents

    @classmethod
    def build(cls, df: DataFrame, vector: str = "embedding", path: str | None = None, cells: int | None = None, sample: int = cl.SAMPLE) -> VectorIndex:
        """Write an index of all rows of `df`, all columns kept; `cells` is about the square root of the rows, `MOST_CELLS` at most.

        Null vectors, those of another length than most and those without a
        direction are kept too, in a cell of their own with similarity 0.
        """
        spark, path = df.sparkSession, path or fresh(df.sparkSession, "vectors")
        n = df.count()
        centroids = cl.fit(df, vector, cells or max(1, min(cl.MOST_CELLS, int(n**0.5))), sample)
        rows = cl.assigned(df, vector, centroids)
        # ranges, not keys: a cell that holds a third of the rows, even of one vector, spreads over tasks
        rows = rows.withColumn("__spread", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange("cell", "angle", "__spread").sortWithinPartitions("cell", "angle").drop("__spread")
        rows.write.partitionBy("cell").parquet(f"{path}/rows")
        spans = cl.Extents.of(spark.read.schema(rows.schema).parquet(f"{path}/rows"), centroids)
        low, high = ({c: float(x) for c, x in zip(spans.ids, of.tolist(), strict=True)} for of in (spans.low, spans.high))
        cells_ = [(c, low.get(c, 0.0), high.get(c, 0.0), size, centroids[c].tolist() if c >= 0 else []) for c, size in spans.size.items()]
        spark.createDataFrame(cells_, _CELLS).coalesce(1).write.parquet(f"{path}/cells")
        spark.createDataFrame([(json.dumps({"vector": vector, "dims": centroids.shape[1], "schema": json.loads(rows.schema.json())}),)], "about string").coalesce(1).write.text(f"{path}/about")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorIndex:
        """An index that was built before; a row for each cell comes to the driver."""
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        rows = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{path}/rows")
        found = {r.cell: r for r in spark.read.schema(_CELLS).parquet(f"{path}/cells").collect()}
        centroids = np.zeros((max(found, default=-1) + 1, about["dims"]))
        for c, r in found.items():
            if c >= 0:
                centroids[c] = r.centroid
        return cls(rows, path, about["vector"], cl.Extents(centroids, {c: (r.low, r.high, r.n) for c, r in found.items()}))

    def _bounds(self, query: list[float]) -> dict[int, float]:
        """The greatest similarity that a row of each cell can have."""
        x, ok = cl.units([query], self.extents.centroids.shape[1])
        bounds = dict(zip(self.extents.ids, np.cos(self.extents.apart(x)[0]).tolist() if ok[0] else [0.0] * len(self.extents.ids), strict=True))
        return bounds | ({cl.NOWHERE: 0.0} if cl.NOWHERE in self.extents.size else {})

    def _scored(self, query: list[float], probed: list[int], keep: Column | None, least: float | None) -> DataFrame:
        rows = self.rows.filter(F.col("cell").isin(probed)) if probed else self.rows.limit(0)
        x, ok = cl.units([query], self.extents.centroids.shape[1])
        if least is not None and 0 < least <= 1 and ok[0] and self.extents.ids:  # rows whose own angle rules them out are not compared
            own = cl.angles(x, self.extents.centroids)[0]
            to = np.full(max(self.extents.ids) + 1, 0.0)
            to[self.extents.ids] = own
            far = F.abs(F.element_at(F.array(*[F.lit(float(a)) for a in to]), F.greatest(F.col("cell"), F.lit(0)) + 1) - F.col("angle"))
            rows = rows.filter((F.col("cell") == cl.NOWHERE) | (far <= float(np.arccos(least)) + cl.SLACK))
        rows = rows if keep is None else rows.filter(keep)
        q = F.array(*[F.lit(float(v)) for v in query])
        return rows.withColumn("score", F.round(cosine(F.col(self.vector), q), DIGITS))

    def probe(self, query: list[float], k: int, keep: Column | None = None) -> tuple[list[int], float | None]:
        """The cells that hold the `k` nearest rows for which `keep` holds, and a similarity that none of them is below."""
        bounds = self._bounds(query)
        order = sorted(bounds, key=lambda c: (-bounds[c], c))
        probed, wanted = [], 2 * k
        while True:
            while len(probed) < len(order) and sum(self.extents.size[c] for c in probed) < wanted:
                probed.append(order[len(probed)])
            if len(probed) == len(order):
                return probed, None
            top = [r.score for r in self._scored(query, probed, keep, None).select("score").orderBy(F.desc("score")).limit(k).collect()]  # k rows
            if len(top) >= k:
                least = top[-1] - 10.0**-DIGITS
                return [c for c in order if c in probed or bounds[c] >= least], least
            wanted = 4 * max(wanted, sum(self.extents.size[c] for c in probed))

    def nearest(self, query: list[float], k: int, *order: str, keep: Column | None = None) -> DataFrame:
        """The `k` rows of greatest cosine similarity to `query` for which `keep` holds, with `score`; ties by the columns of `order`."""
        probed, least = self.probe(query, k, keep)
        return self._scored(query, probed, keep, least).drop("cell", "angle").orderBy(F.desc("score"), *order).limit(k)
