"""Access levels from changes, and chunking as a table function, against recomputing and replay."""

import random

import pytest
from pyspark.sql import functions as F

from engram import catalog
from engram.functions.tokens import Characters
from engram.operators import table_functions
from engram.operators.chunking import by_sentence, pack, packed
from engram.operators.restamping import Restamp

SF = "/root/testdata/sf0.001"
LEVELS = ["public", "channel", "private", "restricted"]


def recomputed(events, links, owners):
    """Ranks of claims and entities from all that holds."""
    claims = {}
    for c, _ in owners:
        ranks = [LEVELS.index(events[e]) if events[e] in LEVELS else 3 for x, e in links if x == c and e in events]
        claims[c] = max(ranks, default=3)
    entities = {}
    for c, e in owners:
        entities[e] = max(entities.get(e, 0), claims[c])
    return claims, entities


def test_changes_give_what_recomputing_gives(spark, tmp_path):
    r = random.Random(7)
    events = {i: r.choice(LEVELS) for i in range(30)}
    links = {(r.randrange(20), r.randrange(34)) for _ in range(50)}  # some before their event
    owners = {(c, f"e{c % 6}") for c in range(18)}  # and some before their claim
    state = Restamp(spark, f"file://{tmp_path}/restamp", buckets=4)
    table = lambda rows, columns: spark.createDataFrame(sorted(rows, key=str), columns)
    of_events = lambda rows: table(rows.items(), "event_id bigint, access_level string")
    of_links = lambda added, gone: table([(c, e, 1) for c, e in added] + [(c, e, -1) for c, e in gone], "claim_id bigint, event_id bigint, n int")
    of_owners = lambda added, gone=(): table([(c, e, 1) for c, e in added] + [(c, e, -1) for c, e in gone], "claim_id bigint, entity_id string, n int")
    state.apply(0, of_events(events), of_links(links, ()), of_owners(owners))
    steps = [
        lambda: ({i: "public" for i in r.sample(range(30), 8)} | {31: "private", 3: "odd"}, set(), set(), set(), set()),
        lambda: ({}, {(5, 2), (18, 3), (19, 30)}, set(r.sample(sorted(links), 12)), {(18, "e0"), (19, "new")}, {(4, "e4"), (10, "e4"), (16, "e4")}),
        lambda: ({1: None, 2: None, 31: "public"}, {(0, 1), (0, 2)}, set(), set(), set()),
    ]
    for n, step in enumerate(steps, 1):
        was = recomputed(events, links, owners)
        levels, more, less, new, gone = step()
        more -= links
        change = state.apply(n, of_events(levels), of_links(more, less), of_owners(new, gone))
        if n == 2:  # the writer was lost: the same change once more
            change = state.apply(n, of_events(levels), of_links(more, less), of_owners(new, gone))
        events = {i: v for i, v in (events | levels).items() if v is not None}
        links, owners = (links | more) - less, (owners | new) - gone
        claims, entities = recomputed(events, links, owners)
        assert {x.claim_id: x.max_tier_rank for x in state.claim_access().collect()} == claims
        assert {x.entity_id: x.max_tier_rank for x in state.entity_access().collect()} == entities
        assert {x.entity_id: x.max_tier_rank for x in change.entities.collect()} == {e: entities.get(e) for e in was[1].keys() | entities.keys() if was[1].get(e) != entities.get(e)}
        assert {x.claim_id: x.max_tier_rank for x in change.claims.collect()} == {c: claims.get(c) for c in was[0].keys() | claims.keys() if was[0].get(c) != claims.get(c)}


def test_limiter_and_table_function_queries(spark):
    replay, stream = catalog.QUERIES["op_t5"](spark, SF), catalog.QUERIES["op_t5_stream"](spark, SF)
    columns = ["actor", "seq", "at", "allowed", F.round("retry_after", 3).alias("wait")]
    assert sorted(map(str, replay.select(*columns).collect())) == sorted(map(str, stream.select(*columns).collect()))
    want, got = catalog.QUERIES["op_c5"](spark, SF), catalog.QUERIES["op_y6"](spark, SF)
    assert sorted(map(str, want.select(*got.columns).collect())) == sorted(map(str, got.collect()))


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_table_function_packs_in_any_blocks(block, monkeypatch):
    monkeypatch.setattr(table_functions, "BLOCK", block)
    r, tokens = random.Random(block), Characters()
    for _ in range(300):
        parts = [" ".join(r.choice(["ab", "Hm.", "longer word", "x" * r.randrange(30)]) for _ in range(r.randrange(8))).strip() or None for _ in range(r.randrange(9))]
        f = table_functions.PackChunks()
        rows = [x for p in [{"k": 1, "at": i, "p": p} for i, p in enumerate(parts)] for x in f.eval(p, "k", "at", "p", "\n", 6, "")] + list(f.terminate())
        want = pack([p for p in parts if p is not None], "\n", 6, tokens, by_sentence(tokens, 6)) or ([""] if parts else [])
        assert [(k, i, c) for k, i, c, _ in rows] == [(1, i, c) for i, c in enumerate(want)] and all(n == tokens.count(c) for *_, c, n in rows)


def test_table_function_in_sql(spark):
    table_functions.register(spark)
    rows = [(k, t, i, s) for k in ("a", "b") for t in (1, 2) for i, s in enumerate(["one two", None, "three four five", "six"])] + [(None, 1, 0, "no key"), ("c", 1, 0, None)]
    spark.createDataFrame(rows[::-1], "k string, t int, i int, s string").createOrReplaceTempView("said")
    got = spark.sql("SELECT * FROM pack_chunks(TABLE(said), 'k, t', 'i', 's', ' ', 5, '')").collect()
    whole = spark.table("said").groupBy("k", "t").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("s").isNotNull(), F.struct("i", "s")))), lambda x: x["s"]).alias("parts"))
    want = whole.select("k", "t", F.posexplode(packed(" ", 5, None)("parts")))
    assert sorted(((x.k or "", x.t, x.chunk_index, x.chunk) for x in got)) == sorted((x.k or "", x.t, x.pos, x.col) for x in want.collect())
    with pytest.raises(Exception, match="pack_chunks needs"):
        spark.sql("SELECT * FROM pack_chunks(TABLE(said), 'k', 'nothing', 's')").collect()
