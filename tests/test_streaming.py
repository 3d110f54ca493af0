"""Streams of changes, requests and events, run to the end of what is there, and again from their checkpoints."""

import datetime as dt
import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from engram.operators import writes
from engram.sources.runs import Runs, newest, summed
from engram.streaming import dirty, limits, upsert

CHANGES = "ws bigint, id bigint"


@pytest.fixture(autouse=True)
def batches_with_data_only(spark):
    """With timers by the clock there is always another batch to look after; a run to the end of what is there needs none without rows."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def put(at, n, rows):
    """Rows as file `n`, later than those of smaller numbers."""
    at.mkdir(exist_ok=True)
    (at / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    os.utime(at / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))


def change(ws, ids):
    return [{"ws": ws, "id": i} for i in ids]


class Draining:
    """A drain over files, stopped and started again with each step."""

    def __init__(self, spark, tmp_path, **bounds):
        self.spark, self.at, self.bounds, self.n = spark, tmp_path, bounds, 0

    def step(self, *rows):
        put(self.at / "in", self.n, rows or [{"ws": None, "id": 1}])
        self.n += 1
        sets = dirty.drained(self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).json(str(self.at / "in")), **self.bounds)
        got = []
        q = sets.writeStream.foreachBatch(lambda b, _: got.extend((r.ws, r.id, r.reason) for r in b.collect())).option("checkpointLocation", str(self.at / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(got)


def test_drain_by_count_over_restarts(spark, tmp_path):
    drain = Draining(spark, tmp_path)
    assert drain.step(*change(1, range(6)), *change(1, range(6)), *change(2, [1]), {"ws": None, "id": 3}, {"ws": 1, "id": None}) == []
    assert drain.step(*change(1, [5, 5, 4])) == []  # ids that are there already don't count again
    assert drain.step(*change(1, range(4, 14))) == [(1, i, "count") for i in range(14)]
    assert drain.step(*change(1, range(9))) == []  # the set is empty after a drain
    assert drain.step(*change(1, [9]), *change(2, range(2, 11))) == [(1, i, "count") for i in range(10)] + [(2, i, "count") for i in range(1, 11)]


def test_drain_by_age_over_a_restart(spark, tmp_path):
    drain = Draining(spark, tmp_path, max_age_seconds=20)
    started = time.time()
    assert drain.step(*change(7, [3, 1])) == []
    since = time.time()
    if drain.step(*change(7, [2])) == []:  # the clock is not set again
        assert time.time() - started < 20 + 10
        time.sleep(max(0, since + 20 - time.time()))
        assert drain.step() == [(7, i, "age") for i in (1, 2, 3)]
    else:
        assert time.time() - started > 20  # a slow machine


def test_ids_expire_one_by_one(spark, tmp_path):
    drain = Draining(spark, tmp_path, least=3, ttl_hours=15 / 3600)
    assert drain.step(*change(1, [1, 2])) == []
    time.sleep(16)
    assert drain.step(*change(1, [3, 4])) == []
    assert drain.step(*change(1, [5])) == [(1, i, "count") for i in (3, 4, 5)]


def test_drained_and_recent_rows(spark, tmp_path):
    put(tmp_path / "in", 0, change(1, range(10)) + change(2, range(3)))
    now = dt.datetime.now()
    rows = spark.createDataFrame([(1, 5, now), (1, 77, now - dt.timedelta(hours=40)), (1, 78, now - dt.timedelta(hours=60)), (2, 79, now)], "ws bigint, id bigint, updated_at timestamp")
    sets = dirty.drained(spark.readStream.schema(CHANGES).json(str(tmp_path / "in")))
    got = []
    q = dirty.consolidate(sets, lambda: rows, lambda ids, _: got.extend((r.ws, r.id) for r in ids.collect()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(got) == [(1, i) for i in range(10)] + [(1, 77)]


@pytest.mark.parametrize("cuts", [(0, 150), (0, 40, 41, 110, 150)])
def test_limiter_is_the_replay_in_any_batches(spark, tmp_path, cuts):
    r = random.Random(4)
    rows = sorted((round(r.random() * 100, 1), i, r.choice("aab")) for i in range(150))
    table = [{"who": k, "t": t, "seq": i} for t, i, k in rows]
    want = {x.seq: (x.allowed, x.retry_after) for x in writes.rate_limited(spark.createDataFrame([(x["who"], x["t"], x["seq"]) for x in table], "who string, t double, seq bigint"), "who", "t", 3, 10.0).collect()}
    got = {}
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        put(tmp_path / "in", n, table[a:b] + [{"who": None, "t": 1.0, "seq": -1}])
        stream = spark.readStream.schema("who string, t double, seq bigint").json(str(tmp_path / "in"))
        q = limits.rate_limited(stream, "who", "t", 3, 10.0).writeStream.foreachBatch(lambda batch, _: got.update({x.seq: (x.allowed, x.retry_after) for x in batch.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert got == want and {a for a, _ in got.values()} == {True, False}


def test_idle_keys_are_forgotten(spark, tmp_path):
    def step(n, rows):
        put(tmp_path / "in", n, rows)
        got = []
        q = limits.rate_limited(spark.readStream.schema("who string, t double, seq bigint").json(str(tmp_path / "in")), "who", "t", 1, 1.0, 1.0).writeStream.foreachBatch(lambda b, _: got.extend((r.key, r.seq, r.allowed) for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return got

    assert step(0, [{"who": "a", "t": 5.0, "seq": 1}]) == [("a", 1, True)]
    time.sleep(3)
    step(1, [{"who": "b", "t": 5.0, "seq": 2}])  # the timer of "a" is due in this batch
    assert step(2, [{"who": "a", "t": 5.0, "seq": 3}]) == [("a", 3, True)]


EVENT = "source_type string, source_id string, access_level string, raw_text string, seq bigint"


def test_upserts_replay(spark, tmp_path):
    row = lambda seq, i, text, level: {"source_type": "chat", "source_id": str(i), "access_level": level, "raw_text": text, "seq": seq}
    put(tmp_path / "in", 0, [row(1, 1, "a", "channel"), row(2, 2, "b", "public"), row(3, 2, "c", "public")])
    out, payload = str(tmp_path / "out"), {"raw_text": "string"}

    def run(checkpoint):
        stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        upsert.upsert_stream(stream, out, str(tmp_path / checkpoint), payload, 4).trigger(availableNow=True).start().awaitTermination(120)
        return {(r.source_id, r.raw_text, r.access_level) for r in upsert.event_table(spark, out, payload, 4).read().collect()}

    assert run("cp") == {("1", "a", "channel"), ("2", "c", "public")}
    put(tmp_path / "in", 1, [row(4, 1, None, "public"), row(5, 2, "d", "private"), row(6, 3, "e", "public")])
    want = {("1", "a", "channel"), ("2", "d", "private"), ("3", "e", "public")}
    assert run("cp") == want
    assert run("cp") == want
    newer = max((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    newer.unlink()  # lost between the write and its commit: the batch comes again
    (tmp_path / "cp" / "commits" / f".{newer.name}.crc").unlink(missing_ok=True)
    assert run("cp") == want


def test_runs_write_in_proportion_and_fold(spark, tmp_path):
    made = []

    class Counted(Runs):
        def _write(self, df, name):
            made.append((name, df.count()))
            super()._write(df, name)

    table = Counted(spark, f"file://{tmp_path}/t", "k bigint, v string", ["k"], newest(["k"]), 4)
    want = {}
    table.add(spark.range(4000).selectExpr("id k", "cast(id as string) v"), 0)
    want.update({i: str(i) for i in range(4000)})
    for n in range(1, 9):
        table.add(spark.createDataFrame([(10 * n + j, f"{n}-{j}") for j in range(20)], "k bigint, v string"), n)
        want.update({10 * n + j: f"{n}-{j}" for j in range(20)})
        assert {r.k: r.v for r in table.read().collect()} == want
        if n == 4:
            table.add(spark.createDataFrame([(10 * n + j, f"{n}-{j}") for j in range(20)], "k bigint, v string"), n)  # a replay
            assert {r.k: r.v for r in table.read().collect()} == want
    assert table.live()[0] == (0, 0)  # small changes don't touch the large run
    assert len(table.live()) < 6 and sum(n for name, n in made if not name.startswith("run=0")) < 9 * 20 * 5
    assert any(a != b for a, b in table.folders())


def test_runs_read_only_buckets_asked_for(spark, tmp_path):
    table = Runs(spark, f"file://{tmp_path}/t", "k bigint, kind string, n bigint", ["k", "kind"], summed(["k", "kind"]), 8)
    assert table.read().count() == 0
    table.add(spark.range(100).selectExpr("id k", "'a' kind", "1L n"), 0)
    table.add(spark.createDataFrame([(5, "a", -1), (6, "b", 2), (None, "a", 1)], "k bigint, kind string, n bigint"), 1)
    few = table.read(spark.createDataFrame([(5,), (6,), (5,), (999,)], "x bigint"))
    assert sorted(map(tuple, few.collect())) == [(6, "a", 1), (6, "b", 2)]
    files = few.select(F.lit(1)).inputFiles()
    assert {f.split("bucket=")[1].split("/")[0] for f in files} and len({f.split("bucket=")[1].split("/")[0] for f in table.read().inputFiles()}) == 8
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert table.read().filter("k is null").count() == 1 and table.read().count() == 101
