"""Components of random graphs, chains and stars against union-find."""

import random

import pytest

from engram.llm import components
from engram.llm.scratch import Scratch


@pytest.mark.parametrize("task_edges", [200_000, 12])
def test_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(components, "TASK_EDGES", task_edges)
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 180)] + [(200, j) for j in range(201, 240)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(9)
    got = {x.node: x.label for x in components.connected_components(df, Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in up}
    assert components.connected_components(df.limit(0), Scratch(spark, "test")).collect() == []
