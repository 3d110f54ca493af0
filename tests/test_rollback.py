"""Merges, clusters and links undone by action, and names in their variants."""

from pyspark.sql import functions as F

from engram.functions.text import name_variants
from engram.operators import actions as act
from engram.operators import resolution


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_merges_undone(spark):
    merges = spark.createDataFrame([("m1", "b", "a"), ("m2", "d", "c")], "action_id string, loser string, winner string")
    rel = spark.createDataFrame([(1, "b", "x"), (2, "y", "b"), (3, "b", "d"), (4, "d", "y"), (5, "b", "z"), (6, "a", "z")], "id bigint, s string, t string")
    columns = ["s", "t"]
    moved = act.moved_by(merges, rel, "id", columns)
    assert rows(moved, "action_id", "row_id", "held") == [("m1", 1, "s"), ("m1", 2, "t"), ("m1", 3, "s"), ("m1", 5, "s"), ("m2", 3, "t"), ("m2", 4, "s")]
    after = resolution.repoint(rel, merges.drop("action_id"), columns).filter("id <> 5")  # 5 is gone
    stands = act.standing(moved, after, "id", columns)
    back = act.move_back(after, stands, act.conflicts(stands), "id", columns)
    whole = [(1, "b", "x"), (2, "y", "b"), (3, "b", "d"), (4, "d", "y"), (6, "a", "z")]
    assert rows(back, "id", *columns) == whole
    again = act.standing(moved, back, "id", columns)
    assert rows(act.move_back(back, again, act.conflicts(again), "id", columns), "id", *columns) == whole

    third = spark.createDataFrame([(1, "q", "x"), (2, "y", "a"), (3, "a", "c"), (4, "c", "y"), (6, "a", "z")], "id bigint, s string, t string")
    stands = act.standing(moved, third, "id", columns)
    blocked = act.conflicts(stands)
    assert rows(blocked, "action_id") == [("m1",)]
    assert rows(act.move_back(third, stands, blocked, "id", columns), "id", *columns) == [(1, "q", "x"), (2, "y", "a"), (3, "a", "d"), (4, "d", "y"), (6, "a", "z")]
    assert rows(act.move_back(third, stands, blocked, "id", columns, force=True), "id", *columns) == [(1, "q", "x"), (2, "y", "b"), (3, "b", "d"), (4, "d", "y"), (6, "a", "z")]

    e = spark.createDataFrame([(i, n, False) for i, n in (("a", "Anna"), ("b", "Ann"), ("c", "Carl"), ("d", "Karl"))], "id string, name string, is_deleted boolean")
    merged = resolution.merge_entities(e, merges.drop("action_id"))
    assert [(r.id, r.is_deleted, r.merged_into, r.aliases) for r in act.restore_losers(merged, merges, blocked).orderBy("id").collect()] == [("a", False, None, ["Ann"]), ("b", True, "a", []), ("c", False, None, []), ("d", False, None, [])]
    assert {r.is_deleted for r in act.restore_losers(merged, merges, blocked, force=True).collect()} == {False}


def test_clusters_and_links_undone(spark):
    e = spark.createDataFrame([("cluster:1", False, None), ("cluster:2", False, None), ("a", False, "cluster:1"), ("b", False, "b0"), ("c", True, "cluster:2")], "id string, is_deleted boolean, part_of string")
    found = spark.createDataFrame([("a", "a0"), ("b", "zero"), ("c", None)], "id string, part_of string")
    undone = spark.createDataFrame([("1",), ("9",)], "action_id string")
    got = {(r.id, r.is_deleted, r.part_of) for r in act.roll_back_clusters(e, undone, found).collect()}
    assert got == {("cluster:1", True, None), ("cluster:2", False, None), ("a", False, "a0"), ("b", False, "b0"), ("c", True, "cluster:2")}
    rel = spark.createDataFrame([(i,) for i in range(4)], "id bigint")
    made = spark.createDataFrame([("1", 0), ("1", 1), ("2", 1), ("2", 2), ("9", 0)], "action_id string, id bigint")
    assert rows(act.roll_back_links(rel, made, undone), "id") == [(1,), (2,), (3,)]


def test_name_variants(spark):
    names = ["ООО «Ромашка»", "Щука GmbH", "Acme Inc.", "", None, "ＡＢ ltd Ltd"]
    got = [tuple(r.v) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(name_variants(F.col("n")).alias("v")).collect()]
    assert got[0] == ("OOO «Romashka»", "«Ромашка»", "«Romashka»")
    assert got[1][1] == "Щука" and got[1][2].startswith("S") and got[1][2].endswith("uka") and got[1][0] == got[1][2] + " GmbH"
    assert got[2] == ("Acme Inc.", "Acme", "Acme") and got[3] == ("", "", "") and got[5][1] == "AB ltd"
