"""Cells around centroids: what cosine search and cosine joins may leave unread.

Vectors are compared by the angle between them, which obeys the triangle
inequality: a vector whose angle to a centroid is `a` and a vector whose angle
to it is `b` are at least |a - b| apart. A cell knows the smallest and largest
angle of its members, so it bounds the similarity of all of them to a given
vector. Centroids come from a bounded sample; every vector is in the cell of its
nearest centroid, and only how much can be left out depends on the sample.
Vectors of another length, or without a direction, are in cell -1; their
similarity to any other is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

#: Distinct vectors that centroids are fitted to, about, and rounds of that.
SAMPLE, ROUNDS = 20_000, 6
MOST_CELLS = 2048
#: Room for rounding in angles.
SLACK = 1e-7
NOWHERE = -1


def units(vectors: list, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one, and which of them have `dims` finite components and a direction; others are zero rows."""
    out, ok = np.zeros((len(vectors), dims)), np.zeros(len(vectors), bool)
    whole = [i for i, v in enumerate(vectors) if v is not None and len(v) == dims and None not in v]
    if whole:
        x = np.array([vectors[i] for i in whole], float)
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
        at = np.array(whole)[good]
        out[at], ok[at] = x[good] / norm[good, None], True
    return out, ok


def angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def fit(df: DataFrame, vector: str, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """`cells` directions, or fewer, by spherical k-means on about `sample` distinct vectors of `df`, chosen by hash."""
    share = max(1, ceil(df.count() / sample))
    some = df.select(F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull() & (F.pmod(F.xxhash64("v"), F.lit(share)) == 0))
    rows = [r.v for r in some.distinct().orderBy(F.xxhash64("v")).limit(2 * sample).collect()]  # `sample` rows, about
    lengths = [len(r) for r in rows]
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n)) if rows else 1
    x, ok = units(rows, dims)
    x = x[ok]
    if not len(x):
        return np.zeros((0, dims))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(ROUNDS):
        near = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centroids)
    return centroids


def assigned(df: DataFrame, vector: str, centroids: np.ndarray) -> DataFrame:
    """`df` with `cell` and `angle`, the angle to its centroid; for cell -1 it is null."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = units(batch.column(vector).to_pylist(), dims)
            cell, angle = np.full(len(x), NOWHERE, np.int32), np.full(len(x), np.nan)
            if ok.any() and len(centroids):
                a = angles(x[ok], centroids)
                cell[ok] = a.argmin(axis=1)
                angle[ok] = a.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(angle, mask=cell < 0)], names=[*batch.schema.names, "cell", "angle"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())]))


class Extents:
    """Centroids and the angles that their members span."""

    def __init__(self, centroids: np.ndarray, spans: dict[int, tuple[float, float, int]]):
        """spans: (smallest angle, largest angle, members) by cell; a cell without members has none."""
        self.ids = sorted(c for c in spans if c >= 0)
        self.centroids = centroids[self.ids] if self.ids else np.zeros((0, centroids.shape[1]))
        self.low, self.high = (np.array([spans[c][i] for c in self.ids]) for i in (0, 1))
        self.size = {c: s[2] for c, s in spans.items()}

    @classmethod
    def of(cls, rows: DataFrame, centroids: np.ndarray) -> Extents:
        """From assigned rows; one row for each cell comes to the driver."""
        spans = rows.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect()
        return cls(centroids, {r.cell: (r.low or 0.0, r.high or 0.0, r.n) for r in spans})

    def apart(self, x: np.ndarray) -> np.ndarray:
        """The least angle between vectors of length one and any member of each cell of `ids`."""
        a = angles(x, self.centroids)
        return np.maximum(np.maximum(a - self.high, self.low - a) - SLACK, 0)
