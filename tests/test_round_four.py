"""Cases of the fourth round's findings."""

from __future__ import annotations

import random
import time

import numpy as np

from engram.functions.similarity import jaro_winkler_against, jaro_winkler_of
from engram.llm import jaccard_join, substring_dedup
from engram.operators import resolution


def test_many_names_are_scored_as_one_by_one():
    """Lengths around 64, common beginnings, letters beyond ASCII, empty texts."""
    rng = random.Random(4)
    for head, letters in (("", "ab"), ("Supplier#", "0123456789"), ("ab", "abé ж")):
        text = lambda: rng.choice(["", head]) + "".join(rng.choices(letters, k=rng.choice([0, 1, 3, 7, 18, 55, 62, 64, 80])))  # noqa: B023, E731
        names = [head + text() for _ in range(60)] + [head]
        score = jaro_winkler_against(names)
        for a in [text() for _ in range(40)] + names[:5]:
            at = np.array(rng.sample(range(61), 30))
            assert score(a, at).tolist() == [jaro_winkler_of(a, names[j]) for j in at.tolist()]


def test_a_search_of_names_starts_from_seeds_and_keeps_classes_together(spark, monkeypatch):
    """Names of one multiset of digits lie in one block, blocks are not joined to few tasks, and every mention brings a score that it has already."""
    seen, in_cells = [], resolution.in_cells
    monkeypatch.setattr(resolution, "in_cells", lambda left, right, on, a, b, compare, schema, *k: seen.append((left.select(a, "seed").collect(), right.select(b, "name").collect(), k[-1])) or in_cells(left, right, on, a, b, compare, schema, *k))
    names = [(i, f"Supplier#{i:09d}") for i in range(2000)]
    asked = [(i, f"Supplier#{i:09d}".replace("00", "0")) for i in range(600)]
    m = spark.createDataFrame([(*x, x[1]) for x in asked], "mention_id bigint, mention string, latin string")
    n = spark.createDataFrame([(*x, x[1]) for x in names], "entity_id bigint, name string, latin string")
    got = {r.mention_id: (r.score, r.entity_id) for r in resolution.nearest_names(m, n).collect()}
    (left, right, tasks), = seen
    assert tasks >= 8 and min(r.seed for r in left) > 0.9
    assert len({r[0] for r in right}) == len({"".join(sorted(r.name)) for r in right})
    for i, text in asked[::7]:
        assert got[i] == min(((jaro_winkler_of(text, name), k) for k, name in names), key=lambda s: (-s[0], s[1]))


def test_covered_members_that_nothing_connects_meet(spark):
    """Chains of seven passages of which only neighbours are alike: two texts that others cover already are linked as well, so a chain stays one."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    docs = []
    for chain in range(30):
        passage = words(54)
        for i in range(7):
            docs.append((10 * chain + i, " ".join(words(40) + passage + words(40))))
            passage = [*passage[: 7 + 6 * i], *words(1), *passage[8 + 6 * i :]]
    found = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    pairs = {(r.doc_id, r.partner_id) for r in found}
    assert all(a // 10 == b // 10 and abs(a - b) == 1 for a, b in pairs)
    links = [(10 * chain + i, 10 * chain + i + 1) in pairs for chain in range(30) for i in range(6)]
    assert sum(links) >= 0.98 * len(links)


def test_alike_sets_without_links_are_searched_in_arrays():
    """400 variants of a set that share more than half of it, few of them linked, took a merge by heap and a look into each long list for every two: 10.9 s, 0.6 s in arrays."""
    r = np.random.default_rng(1)
    base, sets = r.integers(0, 1 << 60, 1000), []
    for _ in range(400):
        other = r.random(1000) > 0.8 + r.random() * 0.1
        sets.append(np.unique(np.where(other, r.integers(0, 1 << 60, 1000), base)).astype(np.uint64))
    sets.sort(key=len)
    start = time.process_time()
    links = jaccard_join.divide_skip(sets, 75)
    spent = time.process_time() - start
    up, want = np.arange(400), np.arange(400)
    for x, y in links:
        up[up == up[y]] = up[x]
    for j in range(400):
        for i in range(j):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True)) if want[i] != want[j] else 0
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                want[want == want[j]] = want[i]
    assert {frozenset(np.flatnonzero(up == c)) for c in up} == {frozenset(np.flatnonzero(want == c)) for c in want}
    assert spent < 5
