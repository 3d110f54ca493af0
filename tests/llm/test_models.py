"""Classifier, decontamination and pipeline."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import decontamination, quality
from engram.llm.text import mix as hash_mix

from .conftest import brute_words, frame
from .test_text_operators import brute_components, scalar_jump

SF = "/root/testdata/sf0.01"
#: Held-out accuracy needs more than the few hundred labels of SF.
LARGER = "/root/testdata/sf0.1"


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    ratings = quality.ratings_of(spark, LARGER)
    model = quality.train(docs, ratings.filter("doc_id % 4 <> 0"))
    held = quality.score(docs, model).join(ratings.filter("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((held.grade == 2) == held.kept).mean() >= 0.9
    assert held[held.grade == 2].kept.mean() >= 0.95
    assert (np.diff(model.threshold) >= 0).all()
    assert held.expected_grade.between(0, 2).all()


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(5)
    grades = r.integers(0, 3, 300)
    features = [np.array([10 + g, *r.integers(100, 140, 5)], np.uint32) for g in grades]
    model = quality.fit(grades, features)
    at = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    assert at.get(10, 0) < at.get(11, 0) < at.get(12, 0)
    score = np.array([sum(at.get(f, 0) for f in set(x.tolist())) for x in features])
    assert (model.tails(score).sum(axis=1).round() == grades).mean() > 0.95


def slow_loss(grades, features, weight, threshold):
    """Mean of -log P(grade), a mean over grades of means over their rows, written out from the model's definition."""
    by = {}
    for g, f in zip(grades.tolist(), features, strict=True):
        s = sum(weight.get(int(x), 0.0) for x in set(f.tolist()))
        below = [0.0, *(1 / (1 + np.exp(-(t - s))) for t in threshold), 1.0]
        by.setdefault(g, []).append(-np.log(below[g + 1] - below[g]))
    return np.mean([np.mean(v) for v in by.values()])


def test_ordinal_fit_is_at_the_maximum_of_the_likelihood():
    """No small step of any weight or threshold makes the slow likelihood better."""
    r = np.random.default_rng(6)
    features = [np.unique(r.choice(8, r.integers(1, 6))).astype(np.uint32) for _ in range(240)]
    true = np.linspace(-2, 2, 8)
    score = np.array([true[f].sum() for f in features]) + r.logistic(size=240)
    grades = np.digitize(score, [-1.0, 1.2])
    model = quality.fit(grades, features, steps=2500, rate=0.02, penalty=0.0, least_docs=1)
    weight, threshold = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True)), model.threshold.tolist()
    best = slow_loss(grades, features, weight, threshold)
    for step in (-0.05, 0.05):
        for f in weight:
            assert slow_loss(grades, features, weight | {f: weight[f] + step}, threshold) > best - 1e-4
        for k in range(2):
            moved = [t + step * (i == k) for i, t in enumerate(threshold)]
            assert slow_loss(grades, features, weight, moved) > best - 1e-4


def test_classifier_edges(spark, rows):
    none = quality.train(frame(spark, rows), spark.createDataFrame([], "doc_id bigint, grade int"))
    got = quality.score(frame(spark, rows), none).collect()
    assert len(got) == len(rows)
    empty = frame(spark, rows).filter(F.lit(False))
    assert quality.score(empty, none).collect() == []
    assert quality.select(frame(spark, rows), none).columns == frame(spark, rows).columns


def brute_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
            best = max(best, h[i, j])
    return best


def test_alignment_is_smith_waterman():
    r = np.random.default_rng(11)
    for _ in range(60):
        a, b = r.integers(0, 6, r.integers(1, 20)).astype(np.uint64), r.integers(0, 6, r.integers(1, 40)).astype(np.uint64)
        assert decontamination.align(a, b)[0] == brute_alignment(a, b)


def leaks():
    r = np.random.default_rng(2)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    items = [" ".join(word() for _ in range(30)) for _ in range(8)]
    edited = items[1].split()
    for i in (5, 12, 20):
        edited[i] = "changed"
    gap = items[2].split()
    del gap[14:17]
    text = lambda n: " ".join(word() for _ in range(n))
    bad = {1: text(40) + " " + items[0].upper() + " " + text(9), 2: " ".join(edited), 3: text(200) + " " + " ".join(gap) + " " + text(3), 4: text(5) + " " + items[0] + " " + text(70) + " " + items[5]}
    clean = {i: text(60) for i in range(10, 30)} | {31: None, 32: "", 33: " ".join(items[6].split()[:6]) + " " + text(50)}
    return items, bad, clean


def test_decontamination(spark, monkeypatch):
    items, bad, clean = leaks()
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "two words")], "item_id bigint, text string")
    docs = frame(spark, [(i, t, "s") for i, t in (bad | clean).items()])
    for block in (20_000, 4):
        monkeypatch.setattr(decontamination, "BLOCK_ITEMS", block)
        found = decontamination.contamination(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in found} == {(1, 0), (2, 1), (3, 2), (4, 0), (4, 5)}
        kept = decontamination.decontaminate(docs, bench)
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(clean)
    for r in found:
        words = brute_words(bad[r.doc_id])[r.first_word : r.end_word]
        assert len(words) <= 30
    assert decontamination.contamination(docs, bench.limit(0)).collect() == []
    assert decontamination.contamination(docs.limit(0), bench).collect() == []


def test_decontamination_of_edited_and_partial_copies(spark):
    """Against brute-force alignment: copies with 20-25 % of their words changed, and halves in one or many documents."""
    r = np.random.default_rng(5)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    text = lambda n: [word() for _ in range(n)]
    items = [text(40) for _ in range(6)]
    changed = lambda item, step: [word() if i % step == step - 1 else w for i, w in enumerate(item)]
    docs = {1: text(30) + changed(items[0], 5) + text(30), 2: text(9) + changed(items[1], 4), 3: text(50) + items[2][:20] + text(50)}
    docs |= {i: text(i) + items[3][20:] + text(3) for i in range(10, 40)}
    docs |= {4: text(8) + items[4] + text(60) + items[4][5:8] + text(70) + items[4] + text(2), 5: items[5][:17] + text(40), 6: text(90)}
    docs |= {7: [w for i in range(0, 40, 4) for w in items[5][i : i + 4] + text(3)]}
    code = {w: i for i, w in enumerate({w for x in [*docs.values(), *items] for w in x})}
    coded = lambda ws: np.array([code[w] for w in ws], np.uint64)
    want = {(d, i): s / 80 for d, t in docs.items() for i, x in enumerate(items) if (s := brute_alignment(coded(x), coded(t))) >= 40}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    table = frame(spark, [(d, " ".join(t), "s") for d, t in docs.items()])
    found = decontamination.contamination(table, bench).collect()
    assert {(f.doc_id, f.item_id): f.score for f in found} == want and {1, 2, 3, 4, 7, 10, 39} <= {d for d, _ in want}
    assert sorted((f.first_word, f.end_word) for f in found if f.doc_id == 4) == [(8, 48), (181, 221)]
    assert len(found) == len(want) + 1
    assert {f.doc_id for f in decontamination.decontaminate(table, bench).collect()} == {5, 6}


def test_decontamination_recall(spark):
    """Of 30-word items with 0 to 8 words changed, every copy that an alignment of all pairs finds."""
    r = np.random.default_rng(12)
    word = lambda: "w" + str(r.integers(0, 1 << 40))
    items = [[word() for _ in range(30)] for _ in range(40)]
    rows, copies = [], []
    for edits in range(9):
        for i, item in enumerate(items):
            t = list(item)
            for at in r.choice(30, edits, replace=False):
                t[at] = word()
            copies.append((edits, i, [word() for _ in range(20)] + t + [word() for _ in range(20)]))
            rows.append((len(rows), " ".join(copies[-1][2]), "s"))
    code = {w: n for n, w in enumerate({w for _, _, t in copies for w in t} | {w for x in items for w in x})}
    coded = lambda ws: np.array([code[w] for w in ws], np.uint64)
    words, want = [coded(x) for x in items], set()
    for d, (_, _, t) in enumerate(copies):
        own = set(t)
        want |= {(d, i) for i, x in enumerate(words) if own & set(items[i]) and decontamination.align(x, coded(t))[0] >= 30}
    assert len(want) == 360
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    found = {(f.doc_id, f.item_id) for f in decontamination.contamination(frame(spark, rows), bench).collect()}
    assert found == want


def test_decontamination_of_every_kind_of_edit(spark):
    """Regular insertions and replacements, and random edits of all kinds, around the score: the same pairs and scores as alignment of all with all."""
    r = np.random.default_rng(21)
    common = [f"c{i}" for i in range(12)]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"w{r.integers(0, 1 << 40)}"
    items = [[word() for _ in range(n)] for n in [30, 30, 3, 4, 5, 8, 15, 60] + [int(r.integers(12, 50)) for _ in range(16)]]
    spread = [x for i in range(0, 30, 2) for x in [*items[0][i : i + 2], word()]]
    third = [word() if i % 3 == 2 else w for i, w in enumerate(items[1])]
    every = [x for w in items[6] for x in (w, word())]
    thinned = [w for i, w in enumerate(items[7]) if i % 4]
    texts = [[*[word() for _ in range(15)], *t, *[word() for _ in range(15)]] for t in (spread, third, every, thinned)]
    for _ in range(220):
        t = list(items[r.integers(len(items))])
        for _ in range(int(r.integers(0, len(t)))):
            at, kind = int(r.integers(len(t))), r.random()
            t[at : at + (kind < 0.66)] = [] if kind < 0.33 and len(t) > 1 else [word()]
        texts.append([*[word() for _ in range(int(r.integers(0, 30)))], *t, *[word() for _ in range(int(r.integers(0, 30)))]])
    code = {w: i for i, w in enumerate({w for x in [*texts, *items] for w in x})}
    coded = lambda ws: np.array([code[w] for w in ws], np.uint64)
    best = {(d, i): decontamination.align(coded(x), coded(t))[0] / (2 * len(x)) for d, t in enumerate(texts) for i, x in enumerate(items)}
    want = {k: round(s, 9) for k, s in best.items() if s >= 0.5}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id bigint, text string")
    got = {}
    for f in decontamination.contamination(frame(spark, [(d, " ".join(t), "s") for d, t in enumerate(texts)]), bench).collect():
        got[f.doc_id, f.item_id] = max(round(f.score, 9), got.get((f.doc_id, f.item_id), 0))
    assert got == want and {(0, 0), (1, 1), (2, 6), (3, 7)} <= set(want)


def test_pipeline_against_brute_force(spark, tmp_path):
    """Each stage's rows, found again from its input by slow versions of the rules."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 300 and n_chars < 6000")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]

    def written(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        back = spark.read.parquet(f"{tmp_path}/{name}")
        assert back.columns == docs.columns
        return back, back.toPandas()

    pdf = docs.toPandas()
    one, kept = written(stages["quality classifier"](spark, docs, SF), "1")
    model = quality.train(docs, quality.ratings_of(spark, SF))
    weight = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))

    def good(text):
        row, feature = quality._chunk([text.encode()])
        score = sum(weight.get(f, 0.0) for f in set(feature.tolist()))
        return 1 / (1 + np.exp(model.threshold[1] - score)) >= 0.5

    assert sorted(kept.doc_id) == sorted(i for i, t in zip(pdf.doc_id, pdf.text, strict=True) if good(t)) and 0 < len(kept) < len(pdf)
    two, unique = written(stages["n-gram Jaccard join"](spark, one, SF), "2")
    comps = brute_components([(i, t, None) for i, t in zip(kept.doc_id, kept.text, strict=True)])
    assert sorted(unique.doc_id) == sorted({c for _, c in comps.values()}) and len(unique) < len(kept)
    three, clean = written(stages["benchmark decontamination"](spark, two, SF), "3")
    items = [brute_words(t) for t in spark.read.parquet(f"{SF}/benchmark.parquet").toPandas().text]
    texts = {i: brute_words(t) for i, t in zip(unique.doc_id, unique.text, strict=True)}
    code = {w: n for n, w in enumerate({w for x in [*texts.values(), *items] for w in x})}
    coded = lambda ws: np.array([code[w] for w in ws], np.uint64)

    def leaks(words):
        own = set(words)
        return any(len(own & set(x)) * 2 >= len(x) and decontamination.align(coded(x), coded(words))[0] >= len(x) for x in items)

    assert sorted(clean.doc_id) == sorted(i for i, ws in texts.items() if not leaks(ws)) and len(clean) < len(unique)
    four, mix = written(stages["mixing sources to target weights"](spark, three, SF), "4")
    size = {s: sum(len(texts[i]) for i in g.doc_id) for s, g in clean.groupby("source")}
    limit, target = {s: 3 * n for s, n in size.items()}, {}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}
    while len(target) < len(size):  # share what is left until none is above
        free = [s for s in size if s not in target]
        level = (sum(size.values()) - sum(target.values())) / sum(weights[s] for s in free)
        over = {s: limit[s] for s in free if level * weights[s] > limit[s]}
        target |= over or {s: level * weights[s] for s in free}
    whole = dict(zip(clean.doc_id, clean.text, strict=True))
    for s, g in mix.groupby("source"):
        assert sum(len(brute_words(t)) for t in g.text) == int(target[s] + 1e-6)
        cut = [(i, t) for i, t in zip(g.doc_id, g.text, strict=True) if t != whole[i]]
        assert len(cut) <= 1 and all(brute_words(whole[i])[: len(brute_words(t))] == brute_words(t) for i, t in cut)
        assert g.doc_id.value_counts().max() - g.doc_id.value_counts().min() <= 1 or size[s] > target[s]
    five = stages["sharding"](spark, four, SF).toPandas()
    assert sorted(five.doc_id) == sorted(mix.doc_id)
    for r in five.itertuples():
        assert r.shard == scalar_jump(int(hash_mix(np.array([r.doc_id], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))[0]), 24)
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in five.groupby("shard"))
