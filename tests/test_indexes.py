"""Indexes against scans: the same rows, and less read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.functions.similarity import cosine, jaro_winkler_of, trigram_similarity, trigrams
from engram.operators import cells, fuzzy, resolution
from engram.operators.search import WebQuery, tokens
from engram.operators.text_index import TextIndex, TrigramIndex
from engram.operators.vector_index import VectorIndex


@pytest.fixture(scope="module")
def clustered(spark):
    """Vectors around 30 directions, one of them held by a third of all rows, with copies, ties, nulls, zeros and other lengths."""
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 8))
    rows = [(i, (centres[i % 30] + r.normal(scale=0.05, size=8)).tolist(), "public" if i % 7 else "private") for i in range(900)]
    rows += [(1000 + i, rows[5][1], "public") for i in range(450)]
    rows += [(2000, None, "public"), (2001, [], "public"), (2002, [0.0] * 8, "public"), (2003, [1.0, 2.0], "public"), (2004, [float("nan")] * 8, "public"), (None, rows[7][1], "public")]
    return rows, spark.createDataFrame(rows, "id bigint, embedding array<double>, level string").repartition(5)


def scan(df, query, k, keep=None):
    q = F.array(*[F.lit(x) for x in query])
    rows = df if keep is None else df.filter(keep)
    return [(r.id, r.score) for r in rows.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)).orderBy(F.desc("score"), "id").limit(k).collect()]


def test_vector_index_is_exact_and_reads_few_cells(spark, clustered):
    rows, df = clustered
    index = VectorIndex.build(df)
    assert index.rows.count() == len(rows)
    rare = (F.col("level") == "private") & (F.col("id") % 3 == 0)
    for query, few in ((rows[3][1], True), (rows[5][1], True), ([-x for x in rows[0][1]], False), ([0.0] * 8, False), ([1.0, 2.0], False)):
        for k, keep in ((5, None), (40, F.col("level") == "private"), (30, rare)):
            got = [(r.id, r.score) for r in index.nearest(query, k, "id", keep=keep).collect()]
            assert got == scan(df, query, k, keep)
        if few:
            probed, least = index.probe(query, 5)
            assert len(probed) <= 4 < len(index.extents.size) and least > 0.9
            plan = index.nearest(query, 5, "id")._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    many = index.nearest(rows[3][1], 5000, "id").collect()
    assert len(many) == len(rows)


def test_vector_index_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([], "id bigint, embedding array<double>")
    assert VectorIndex.build(none).nearest([1.0, 0.0], 3, "id").collect() == []
    for v in ([1.0, 0.0], None, [0.0, 0.0]):
        got = VectorIndex.build(spark.createDataFrame([(1, v)], none.schema)).nearest([1.0, 0.0], 3, "id").collect()
        assert [(r.id, r.score) for r in got] == [(1, 1.0 if v == [1.0, 0.0] else 0.0)]


def test_an_index_opens_again(spark, clustered):
    rows, df = clustered
    index = VectorIndex.build(df, cells=12)
    again = VectorIndex.open(spark, index.path)
    assert again.probe(rows[4][1], 6) == index.probe(rows[4][1], 6)
    assert again.nearest(rows[4][1], 6, "id").collect() == index.nearest(rows[4][1], 6, "id").collect()


def test_cosine_join_overlaps_few_cells(spark, clustered):
    """The same pairs as all against all, from a few cells of each row; a hot vector is dealt out in blocks."""
    rows, df = clustered
    e = df.filter("id is not null").select("id", F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("entity_type"), F.lit("name").alias("name"), "embedding")
    ids = {i: (np.array(v) / max(np.linalg.norm(v), 1e-300), i % 2) for i, v, _ in rows if i is not None and v and len(v) == 8 and not np.isnan(v).any()}
    want = set()
    for i, (x, kind) in ids.items():
        near = sorted((-round(float(x @ y), 9), j) for j, (y, other) in ids.items() if j != i and other == kind and round(float(x @ y), 9) >= 0.95)
        want |= {(min(i, j), max(i, j)) for _, j in near[:4]}
    got = resolution.shortlist(e, 4, 0.95, rows=64)
    assert {(r.a, r.b) for r in got.collect()} == want
    own, asked = resolution.overlapping(e.select("id", F.col("entity_type").alias("kind"), "embedding").filter("embedding is not null"), 0.95, rows=64)
    assert own.select("place").distinct().count() > 20
    assert asked.count() < 3 * own.count()


def test_extents_bound_every_member():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centroids = x[:9]
    a = cells.angles(x, centroids)
    near = a.argmin(axis=1)
    e = cells.Extents(centroids, {c: (a[near == c, c].min(), a[near == c, c].max(), int((near == c).sum())) for c in range(9)})
    apart = e.apart(x)
    for c in range(9):
        assert (apart[:, c][:, None] <= cells.angles(x, x[near == c]) + 1e-6).all()


QUERIES = ["red", "red blue", 'red -blue or "green red"', '"red red blue"', '"red blue" or "blue red" white', "-red", "nosuchword", 'red or -blue or "x y" "red blue"', "RED Größe", '""', 'straße "größe, red"']


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    words = ["red", "blue", "green", "white", "Größe", "straße", "x", "y", "the"]
    rows = [(f"k{i}", " ".join(r.choice(words) for _ in range(r.randint(0, 9))), r.choice(["public", "private"])) for i in range(400)]
    rows += [(f"t{i}", "the " * 50, "public") for i in range(300)] + [("n", None, "public"), ("e", "", "private"), ("long", "red blue, " * 3000 + "green red", "public"), (None, "red", "public")]
    return spark.createDataFrame(rows, "key string, text string, level string").repartition(4)


def test_text_index_matches_like_a_scan(spark, texts):
    index = TextIndex.build(texts, "key", "text", ["level"], buckets=16)
    public = F.col("level") == "public"
    for q in map(WebQuery.parse, QUERIES):
        scanned = texts.filter("key is not null").withColumn("__t", tokens(F.col("text"))).filter(q.matches(F.col("__t"))).select("key", "text", q.rank(F.col("__t")).cast("bigint").alias("score"), "level")
        want = {(r.key, r.score, r.level) for r in scanned.collect()}
        assert {(r.key, r.score, r.level) for r in index.matches(q).collect()} == want
        best = sorted(((-s, k) for k, s, at in want if at == "public"))[:7]
        got = index.top(q, 7, public).collect()
        assert sorted((-r.score, r.key) for r in got) == best
        assert {(r.key, r.text) for r in got} <= {(r.key, r.text) for r in scanned.collect()}
    plan = index.matches(WebQuery.parse("red -blue"), public)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [bucket") + plan.count("PartitionFilters: [isnotnull(bucket") >= 1 and "text" not in plan.replace("/engram-text-", "")


def test_trigram_index_is_a_scan(spark):
    r = random.Random(3)
    names = [(i, " ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 3)))) for i in range(500)] + [(900, None), (901, "Straße Äb")]
    df = spark.createDataFrame(names, "id bigint, name string")
    index = TrigramIndex.build(df, "id", "name", buckets=8)
    for query in ("abca", "dcba abcd a", "straße", "", "zzz"):
        for least in (0.1, 0.4):
            scored = df.select("id", F.round(trigram_similarity(trigrams(F.col("name")), trigrams(F.lit(query))), 6).alias("score")).filter(F.col("score") > least)
            want = sorted((-x.score, x.id) for x in scored.collect())
            assert sorted((-x.score, x.key) for x in index.similar(query, least).collect()) == want
            assert sorted((-x.score, x.key) for x in index.top(query, 9, least).collect()) == want[:9]


def alike_names(r, n, letters="abcdefghijklmnoprstuvwyé -"):
    """Names, each with edited ones: replaced, deleted, inserted and moved characters, and long names cut and repeated."""
    names = set()
    for _ in range(n):
        name = [r.choice(letters) for _ in range(r.choice([*range(1, 16), 45, 90]))]
        names.add("".join(name))
        for _ in range(3):
            for _ in range(r.randint(1, 3)):
                at, kind = r.randrange(len(name)), r.random()
                name[at : at + (kind < 0.6)] = [] if kind < 0.3 and len(name) > 1 else [r.choice(letters)]
            names.add("".join(name))
    return sorted(x for x in names if x)


def test_no_alike_pair_is_filtered_out():
    names = alike_names(random.Random(5), 90) + ["a", "aa", "ab", "abcd" * 30, "abcd" * 24]
    rank = {(c, i): j for j, (c, i) in enumerate((c, i) for i in range(8, 0, -1) for c in "zyabcdefghijklmnoprstuvwé -")}
    for least in (0.85, 0.9, 0.97):
        signed = {n: set(fuzzy.Signatures(least, rank).of(n).tolist()) for n in names}
        for i, a in enumerate(names):
            assert all(signed[a] & signed[b] for b in names[i:] if jaro_winkler_of(a, b) >= least)


def test_alike_pairs_and_few_candidates(spark):
    """Equal to all pairs; twice the names give about twice the candidates where the pairs themselves do."""
    counted = []
    for n in (60, 120):
        names = alike_names(random.Random(n), n)
        df = spark.createDataFrame([(x,) for x in names] + [(None,), ("",), (names[0],)], "name string")
        want = {(a, b) for a in names for b in names if jaro_winkler_of(a, b) >= 0.9}
        assert {(r.a, r.b) for r in fuzzy.alike(df, df, 0.9).collect()} == want
        counted.append(fuzzy.candidates(df.filter("name is not null"), df.filter("name is not null"), 0.9, fuzzy._rarity(df.filter("name is not null"))).count())
        assert counted[-1] < 0.05 * len(names) ** 2
    assert counted[1] < 3 * counted[0]


def test_most_alike_in_steps(spark):
    r = random.Random(9)
    names = alike_names(r, 40)
    latin = {x: x.replace("é", "e") for x in names}
    mentions = [(i, x[: max(1, len(x) - r.randint(0, 2))] + r.choice(["", "q"])) for i, x in enumerate(names[::2])]
    m = spark.createDataFrame([(i, x, x.replace("é", "e")) for i, x in mentions] + [(999, None, None)], "mention_id long, mention string, latin string")
    n = spark.createDataFrame([(i, x, latin[x]) for i, x in enumerate(names)] + [(998, None, None)], "entity_id long, name string, latin string")
    score = lambda a, b: max(jaro_winkler_of(a, b), jaro_winkler_of(a.replace("é", "e"), b), jaro_winkler_of(a, latin[b]))
    want = {i: min((-score(x, b), j) for j, b in enumerate(names)) for i, x in mentions}
    got = {x.mention_id: (-x.score, x.entity_id) for x in fuzzy.most_alike(m, n).collect()}
    assert got == {i: w for i, w in want.items() if -w[0] >= 0.85}
    assert fuzzy.most_alike(m.limit(0), n).collect() == []
