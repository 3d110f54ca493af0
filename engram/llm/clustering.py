"""Centroid clustering: exact k-means over integers by Shallot search.

Every vector remembers its nearest and its second-nearest centroid, with an
upper bound of the distance to the one and a lower bound of the distance to all
others. When centroids move, the bounds give way by as much. A vector whose
upper bound stays below the lower one, or below half the gap from its centroid
to the next, keeps its centroid unseen. For the others a scan starts at the
closer of the two remembered centroids and takes the centroids in the order of
their distance from there. It ends when none further on can beat the
second-nearest found so far, so the ball shrinks while it is searched. What is
left is compared in integers: floating-point bounds only ever rule out, with
room to spare.

A round reads the table of the round before and writes the next; the new
centroids come from sums of integers that Spark aggregates, a row for each
centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

CENTROIDS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
#: Room for rounding in bounds.
SLACK = 1e-9
#: Vectors that a task compares at once.
ROWS = 4096


class Centroids:
    """Integer centroids, and of each one all centroids in the order of their distance."""

    def __init__(self, points: np.ndarray):
        self.points = points
        gap = np.array([np.sqrt(((points - p) ** 2).sum(axis=1).astype(float)) for p in points]).reshape(len(points), len(points))
        np.fill_diagonal(gap, -1)
        self.near = np.argsort(gap, axis=1, kind="stable")  # itself first
        self.gap = np.take_along_axis(gap, self.near, axis=1)
        self.half = self.gap[:, 1] / 2 if len(points) > 1 else np.full(len(points), np.inf)

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances, as integers."""
        return ((x - self.points[which]) ** 2).sum(axis=1)

    def assign(self, x: np.ndarray, nearest: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring the nearest and second-nearest centroids and the bounds up to date, in place."""
        if len(self.points) == 1:
            return
        sure = lambda at: upper[at] * (1 + SLACK) + SLACK < np.maximum(lower[at], self.half[nearest[at]])
        todo = np.arange(len(x))
        todo = todo[~sure(todo)]
        here = self.distances(x[todo], nearest[todo])
        upper[todo] = np.sqrt(here)
        open_ = ~sure(todo)
        todo, best = todo[open_], here[open_]
        own, other = nearest[todo], second[todo]
        next_ = self.distances(x[todo], other)
        swap = (next_ < best) | ((next_ == best) & (other < own))
        own, other, best, next_ = np.where(swap, other, own), np.where(swap, own, other), np.where(swap, next_, best), np.where(swap, best, next_)
        start, reach, live = own.copy(), np.sqrt(best), np.arange(len(todo))
        for place in range(1, len(self.points)):
            ball = (reach[live] + np.sqrt(next_[live])) * (1 + SLACK) + SLACK
            live = live[self.gap[start[live], place] <= ball]
            if not len(live):
                break
            j = self.near[start[live], place]
            fresh = (j != own[live]) & (j != other[live])
            at, j = live[fresh], j[fresh]
            d = self.distances(x[todo[at]], j)
            first = (d < best[at]) | ((d == best[at]) & (j < own[at]))
            then = ~first & ((d < next_[at]) | ((d == next_[at]) & (j < other[at])))
            a = at[first]
            other[a], next_[a] = own[a], best[a]
            own[a], best[a] = j[first], d[first]
            other[at[then]], next_[at[then]] = j[then], d[then]
        nearest[todo], second[todo], upper[todo], lower[todo] = own, other, np.sqrt(best), np.sqrt(next_)


def _moves(old: Centroids | None, new: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and how far any other did."""
    if old is None:
        return np.zeros(len(new.points)), np.zeros(len(new.points))
    moved = np.sqrt(((new.points - old.points) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
    others = np.array([np.delete(moved, i).max(initial=0) for i in range(len(moved))])
    return moved, others


_STATE = "vec_id bigint, v array<int>, cluster int, second int, upper double, lower double, distance bigint"


def _round(old: Centroids | None, new: Centroids):
    moved, others = _moves(old, new)
    dims = new.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                n = batch.num_rows
                lists = batch.column("v")
                x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, dims)
                if old is None:
                    nearest, second = np.zeros(n, np.int64), np.full(n, min(1, len(new.points) - 1), np.int64)
                    upper, lower = np.full(n, np.inf), np.zeros(n)
                else:
                    nearest, second = (batch.column(c).to_numpy().astype(np.int64) for c in ("cluster", "second"))
                    upper, lower = batch.column("upper").to_numpy() + moved[nearest], batch.column("lower").to_numpy() - others[nearest]
                new.assign(x, nearest, second, upper, lower)
                columns = [batch.column("vec_id"), lists, pa.array(nearest, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), pa.array(new.distances(x, nearest))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "cluster", "second", "upper", "lower", "distance"])

    return run


def integer_vectors(vectors: DataFrame, dims: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the rows of `vectors` (vec_id, embedding) with `dims` finite components, each as floor(scale * x).

    A component so large that squared distances would leave 64 bits stops the job.
    """
    most = isqrt(2**63 // max(dims, 1)) // 2 - 1
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    whole = lambda c: F.when(F.abs(c) * scale < min(most, 2**31 - 1), F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("int"))
    return vectors.filter((F.size(x) == dims) & finite).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of `vectors` (vec_id, embedding; other columns are not read) that `integer_vectors` keeps.

    Centroids 0, 1, ... start as the `k` vectors of smallest SHA-256 of
    "seed:vec_id", in that order; null vec_ids come last, and of rows of one
    vec_id the smaller vector first. In each of `rounds` rounds all vectors go
    to their nearest centroid (ties: the smaller number), and every centroid
    with vectors becomes the floor of their mean. Then all are assigned once
    more. Repeated rows count as often as they are there. Null, short, long and
    non-finite vectors have no row; with fewer than `k` vectors there are as
    many centroids as vectors, and none gives an empty result. `k` bounds what
    the driver and each task hold: k vectors and k * k distances.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "clusters")
    state = scratch.table(integer_vectors(vectors, dims, scale), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    points = [r.v for r in state.orderBy(order.asc_nulls_last(), "v").limit(k).collect()]  # k rows
    if not points:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    old, new = None, Centroids(np.array(points, np.int64).reshape(len(points), dims))
    for number in range(rounds + 1):
        before, state = state, scratch.table(state.mapInArrow(_round(old, new), _STATE), "assigned")
        scratch.drop(before)
        if number == rounds:
            break
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in range(dims)]).alias("sums")).collect()  # k rows
        points = new.points.copy()
        for r in sums:
            points[r.cluster] = [s // r.n for s in r.sums]
        old, new = new, Centroids(points)
    sizes = {r.cluster: r.d for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    names = [(c, sizes[c], sum(sizes.values()), hashlib.sha256(",".join(map(str, new.points[c].tolist())).encode()).hexdigest()) for c in sorted(sizes)]
    of = F.broadcast(spark.createDataFrame(names, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"))  # k rows
    return state.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(rounds: int = ROUNDS) -> str:
    """The same by plain search in DuckDB: every vector against every centroid."""
    parts = [
        "v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 16)",
    ]
    for i in range(rounds + 1):
        square = "list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT vec_id, v.v AS v, min(struct_pack(d := {square}, c := c.c)) AS best FROM v CROSS JOIN c{i} c GROUP BY ALL)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT c, i, sum(x::HUGEINT) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY ALL)")
            parts.append(f"m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM s{i} GROUP BY c)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c)")
    last = f"SELECT a.vec_id, a.best.c::INT AS cluster, a.best.d::BIGINT AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia, sum(a.best.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"
    return f"WITH {', '.join(parts)} {last}"


ORACLE = _oracle()
