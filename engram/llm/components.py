"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that one task contracts, about.
TASK_EDGES = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a partition's edges by one star for each of its components."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, r) for x in list(parent) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["u", "v"])


def _is_stars(now: DataFrame) -> bool:
    """Whether every node has at most one parent, and no parent has one itself."""
    nodes = now.groupBy("u").agg(F.count("*").alias("up"), F.lit(0).cast("bigint").alias("down"))
    parents = now.select("v").distinct().select(F.col("v").alias("u"), F.lit(0).cast("bigint").alias("up"), F.lit(1).cast("bigint").alias("down"))
    both = nodes.union(parents).groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return both.filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of `edges` (its first two columns, bigint): label is the component's smallest node.

    Tasks first contract `TASK_EDGES` edges each to stars; then large-star and
    small-star steps alternate until only stars are left. Self links and nulls are
    left out; an empty edge list gives an empty result.
    """
    u, v = edges.columns[:2]
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u > v")
    e = scratch.table(e, "edges")
    now = scratch.table(e.coalesce(max(1, ceil(e.count() / TASK_EDGES))).mapInArrow(_contract, "u bigint, v bigint").distinct(), "stars")
    while not _is_stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        step = joined.select("u", F.col("m").alias("v")).union(joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = scratch.table(step.distinct(), "stars")
        scratch.drop(now)
        now = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
