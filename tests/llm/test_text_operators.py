"""Operators against brute force, on small inputs with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from engram.llm import exact_dedup, jaccard_join, line_dedup, mixing, sharding, substring_dedup, text, token_counts, token_output, tokens
from engram.llm.scratch import Scratch, SortedRun, stored_order
from engram.llm.text import mix

from .conftest import brute_words, frame

SPACE = re.compile(r"[\x20\x09-\x0D]")


def shingles(text, k=5):
    w = brute_words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows):
    sets = [shingles(t) for _, t, _ in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _, _) in enumerate(rows)}


def jaccard_of(spark, rows):
    got = jaccard_join.jaccard_join(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


#: Small chunks, buckets and crowds, and groups that no task takes whole: pivots, then blocks.
TIGHT = {"CHUNK_TOKENS": 300, "LEFT_TOKENS": 200, "BUCKET_TOKENS": 500, "CROWD": 3, "GROUP_TOKENS": 150}


@pytest.fixture(params=[{}, TIGHT, TIGHT | {"PIVOTS": 1, "GROUP_TOKENS": 400}], ids=["wide", "tight", "blocks"])
def sized(request, monkeypatch):
    for name, value in request.param.items():
        monkeypatch.setattr(jaccard_join, name, value)


def test_jaccard_join(spark, rows, sized):
    assert jaccard_of(spark, rows) == brute_components(rows)


def contained_pairs(seed):
    """Texts of 75 shingles, each inside one of 100, and for each of both several partners that share more short lists but link to none."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    rows = []
    for _ in range(24):
        inner = [word() for _ in range(79)]
        texts = [inner, inner + [word() for _ in range(25)]]
        for base, share in ((0, 60), (1, 80)):
            texts += [texts[base][:share] + [word() for _ in range(len(texts[base]) - share)] for _ in range(2)]
            texts += [[word() for _ in range(len(texts[base]) - share)] + texts[base][-share:] for _ in range(2)]
        rows += [(len(rows) + i, " ".join(t), "s") for i, t in enumerate(texts)]
    return rows


def test_jaccard_join_of_unequal_sizes(spark, sized):
    """A set of 75 shingles in one of 100 is a link of exactly 0.75, though its other lists meet nobody."""
    rows = contained_pairs(1)
    assert jaccard_of(spark, rows) == brute_components(rows)


def near_groups(seed):
    """Chains and stars of edited copies with similarities on both sides of 0.75, and passages that all of them share."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghij"), 6))
    shared, rows = [word() for _ in range(40)], []
    for g in range(14):
        base = [word() for _ in range(int(r.integers(6, 160)))] + (shared if g % 2 else [])
        last = base
        for _ in range(9):
            t = list(last if g % 3 else base)
            for _ in range(int(r.integers(0, max(2, len(t) // 18)))):
                at = int(r.integers(0, len(t)))
                t[at : at + int(r.integers(0, 3))] = [word() for _ in range(int(r.integers(0, 3)))]
            rows.append(t)
            last = t
    order = r.permutation(len(rows))
    return [(int(i), " ".join(rows[j]), "s") for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_near_groups(spark, sized, seed):
    rows = near_groups(seed)
    want = brute_components(rows)
    assert 20 < len({c for _, c in want.values()}) < 120
    assert jaccard_of(spark, rows) == want


def test_divide_skip_joins_what_links_connect():
    r = np.random.default_rng(9)
    for case in range(60):
        base = r.permutation(400)[: int(r.integers(5, 60))]
        sets = []
        for _ in range(int(r.integers(1, 25))):
            own = np.where(r.random(len(base)) < r.choice([0.02, 0.1, 0.25]), r.integers(1000, 3000, len(base)), base)
            sets.append(np.unique(own[: len(own) - int(r.integers(0, len(own) // 3 + 1))]).astype(np.uint64))
        sets.sort(key=len)
        linked = lambda x, y: 100 * len(np.intersect1d(x, y)) >= 75 * len(np.union1d(x, y))
        known = np.arange(len(sets)) // 2 * 2 if case % 2 else np.arange(len(sets))

        def classes(links):
            up = known.copy()
            for x, y in links:
                up[up == up[y]] = up[x]
            return {frozenset(np.flatnonzero(up == c).tolist()) for c in up}

        links = jaccard_join.divide_skip(sets, 75, known)
        assert all(linked(sets[x], sets[y]) for x, y in links)
        assert classes(links) == classes([(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])])


def thue_morse():
    """Complementary words, which collide under every polynomial modulo 2**64."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_regular_patterns_differ(spark):
    one, other = thue_morse()
    h = text.Words([one.encode(), other.encode(), one.upper().encode(), b"x " + other.encode()]).hashes
    assert h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3
    rows = [(1, one, "s"), (2, other, "s"), (3, " ".join([one] * 60), "s"), (4, " ".join([other] * 60), "s")]
    assert jaccard_of(spark, rows[:2]) == {1: (1, 1), 2: (1, 2)}
    assert substring_dedup.substring_dedup(frame(spark, rows)).collect() == []


def test_encoder_is_exact():
    """Words of equal hash, a memory that is too small, and texts of more distinct words than it holds."""
    one, other = thue_morse()
    texts = [one, other, f"{other} {one} {one}", "", " a  B\ta b, C. ", "".join(chr(97 + i % 26) + " " * (i % 3 == 0) for i in range(5000)), "ünï <|endoftext|> x"]
    want = reference_ids(texts)
    encoder = tokens.Encoder(tokens.VOCABULARY)
    for remembered, spelt in ((1_000_000, 1 << 26), (3, 1 << 26), (1_000_000, 10)):
        tokens.REMEMBERED, tokens.REMEMBERED_BYTES = remembered, spelt
        for _ in range(2):
            n, ids = encoder.encode([t.encode() for t in texts])
            assert np.split(ids, np.cumsum(n)[:-1])[0].tolist() == want[0] and ids.tolist() == [i for w in want for i in w]
    tokens.REMEMBERED, tokens.REMEMBERED_BYTES = 1_000_000, 64 << 20
    encoder.known[:] = np.sort(text.Words([b"a B c"], key=encoder.key).hashes.tolist() * len(encoder.known))[: len(encoder.known)]  # hashes that now stand for other words
    assert encoder.encode([b"a B c"])[1].tolist() == reference_ids(["a b c"])[0]


def test_jaccard_keeps_one_of_each_group(spark, rows):
    want = {c for _, c in brute_components(rows).values()}
    kept = jaccard_join.one_of_each_group(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == want


def test_exact_dedup(spark, rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[SPACE.sub("", t or "")].append((-len(t or ""), d))
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    keep = {d: (min(g)[1], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, d in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in got} == keep
    assert Counter(r.keep_id for r in got if r.kept) == Counter(min(g)[1] for g in groups.values())


def tasks_of(df, column):
    """Rows of each task, and the rows of each value of `column`."""
    return [r["count"] for r in df.groupBy(column).count().collect()]


@pytest.mark.parametrize("doc_id", [None, 7])
def test_exact_dedup_of_rows_that_repeat_in_all_columns(spark, doc_id, monkeypatch):
    """A text of one doc_id, or of none, in most rows is sorted in many parts, and one of its rows stays."""
    seen, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name="table": seen.setdefault(name, table(self, df, name)))
    rows = [(doc_id, "a b c", "s")] * 2000 + [(i, f"text {i}", "s") for i in range(100, 1100)]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    same = [r for r in got if r.group_size == 2000]
    assert len(got) == 3000 and len(same) == 2000 and {r.keep_id for r in same} == {doc_id}
    assert sum(r.kept for r in same) == 1 and all(r.kept for r in got if r.group_size == 1)
    parts = tasks_of(seen["sorted"].filter("size = 5"), "salt")
    assert len(parts) > 500 and max(parts) < 20


@pytest.mark.parametrize("share", [1024, 20, 1 << 40])
def test_line_dedup(spark, rows, share, monkeypatch):
    """With hot lines as they come, with more of them, and with every line hot."""
    monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0 if share == 20 else 32 << 20)
    tables = set(r.tableName for r in spark.sql("show tables").collect())
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = defaultdict(set)
    for d, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(d)
    want = []
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == d]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    for fanout, batches in ((2, 4), (3, 1)):
        got = line_dedup.line_dedup(frame(spark, rows), batches=batches, fanout=fanout).collect()
        assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got) == sorted(want)
    assert set(r.tableName for r in spark.sql("show tables").collect()) == tables


def test_runs_are_joined_in_stored_order(spark):
    """A merge join of two runs needs neither exchange nor sort."""
    scratch = Scratch(spark, "test")
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("key"), F.col("id").alias("first"))
    a, b = (SortedRun(scratch, rows.filter(f"first % 3 = {i}"), "key", 4) for i in (0, 1))
    with stored_order(spark):
        df = a.read().hint("merge").join(b.read().withColumnRenamed("first", "other"), "key", "full")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 3334
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort " not in plan
    a.drop()
    b.drop()


def test_mixing(spark, rows):
    got = mixing.mix(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((d, len(brute_words(t))) for d, t, _ in rows)
    total, by = sum(r.size for r in got), defaultdict(int)
    for r in got:
        by[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    target, capped = {}, set()
    while True:  # share the excess again until none is above
        free = [s for s in by if s not in capped]
        rest = total - sum(3 * by[s] for s in capped)
        target = {s: 3 * by[s] if s in capped else rest * weight[s] / sum(weight[x] for x in free) for s in by}
        over = {s for s in free if target[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source])
        assert r.source_size == by[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in by)
    again = mixing.mix(frame(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    docs = mixing.mixed_documents(frame(spark, rows))
    words = sum(len(brute_words(r.text)) for r in docs.collect())
    assert words == sum(r.taken for r in got)


def test_mixed_documents_with_null_and_repeated_ids(spark):
    """Rows alike in doc_id, source and size: each is whole as often as it is taken, and one row of a source is cut."""
    rows = [(None if i % 3 else 7, f"  a{i}\n\tb{i}  c{i} d{i} ", s) for s in ("s0", "s1", "s2", None) for i in range(99)]
    rows += [(None, t, s) for s in ("s0", None) for t in (None, "", " \n")]
    docs = frame(spark, rows).withColumns({c: F.lit("x") for c in ("rows", "taken", "size", "__size", "__mix_place", "epochs", "last", "range", "a.b")}).withColumn("m", F.create_map("lang", "text"))
    plan = mixing.mix(docs).collect()
    target = {r.source: int(r.target) for r in plan}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    texts, words, cut = {(t, s) for _, t, s in rows}, Counter(), Counter()
    for r in got.collect():
        words[r.source] += len(brute_words(r.text))
        cut[r.source] += (r.text, r.source) not in texts
    assert words == target
    assert all(cut[s] == (target[s] % 4 > 0) for s in target) and any(cut.values())


def test_sharding(spark, rows):
    got = sharding.shard(frame(spark, rows), 5).collect()
    assert len(got) == len(rows)
    texts = {d: (t or "").encode() for d, t, _ in rows}
    slots = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 5)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    keys = np.arange(20000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    few, more = sharding.jump_hash(keys, 24), sharding.jump_hash(keys, 25)
    moved = few != more
    assert set(more[moved]) == {24} and 0.03 < moved.mean() < 0.05
    assert np.bincount(few, minlength=24).min() > 20000 / 24 * 0.8


def scalar_jump(key, shards):
    at, to = -1, 0
    while to < shards:
        at = to
        key = (key * 2862933555777941757 + 1) % 2**64
        to = int((at + 1) * (2.0**31 / ((key >> 33) + 1)))
    return at


def test_jump_hash_of_large_ids_beside_nulls(spark, tmp_path):
    """A doc_id's shard is that of the scalar rule, whatever its neighbours are."""
    r = np.random.default_rng(8)
    ids = [*(2**53 + r.integers(0, 2**62, 300)).tolist(), -1, 0, 2**63 - 1, -(2**63)]
    want = dict(zip(ids, sharding.jump_hash(mix(np.array(ids, np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 24).tolist(), strict=True))
    for k in r.integers(0, 2**63, 50).tolist():
        assert sharding.jump_hash(np.array([k], np.uint64), 24)[0] == scalar_jump(k, 24)
    for rows in (ids, [x for i in ids for x in (i, None)]):
        docs = spark.createDataFrame([(i, "t") for i in rows], "doc_id bigint, text string").coalesce(1)
        got = sharding.shard(docs).collect()
        assert {r.doc_id: r["shard"] for r in got if r.doc_id is not None} == want
        assert len({r["shard"] for r in got if r.doc_id is None}) == (None in rows)
    sharding.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert {r.doc_id: r["shard"] for r in back if r.doc_id is not None} == want and len(back) == 2 * len(ids)
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), f"{tmp_path}/again")


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_token_output(spark, rows):
    scratch = Scratch(spark, "test")
    at = scratch.path("orc")
    token_output.write_tokens(frame(spark, rows), at)
    got = token_output.token_index(token_output.read_tokens(spark, at), scratch).collect()
    ids = {d: i + [1] for (d, _, _), i in zip(rows, reference_ids([t or "" for _, t, _ in rows]), strict=True)}
    start = 0
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        want = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert len(got) == len(rows)
    one = token_output.read_tokens(spark, at).filter("doc_id = 60")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,60)]" in one._sc._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("texts", [["same text"], ["one", "two b", None, ""]], ids=["one text", "several texts"])
def test_token_output_of_null_and_repeated_ids(spark, texts):
    """Rows of one doc_id, or of none, go to several files, one behind the other, and a rerun writes the same."""
    rows = [(None if i % 3 else 7, texts[i % len(texts)], "s") for i in range(3000)] + [(8, "last", "s")]
    runs = []
    for docs in (frame(spark, rows), frame(spark, rows[::-1]).repartition(5)):
        scratch = Scratch(spark, "test")
        at = scratch.path("orc")
        token_output.write_tokens(docs, at)
        tokens_ = token_output.read_tokens(spark, at)
        files = tasks_of(tokens_, "part")
        assert len(files) == 4 and max(files) < 1500
        got = token_output.token_index(tokens_, scratch).collect()
        runs.append(sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got))
    ids = [i + [1] for i in reference_ids([t or "" for _, t, _ in rows])]
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _, _), i in zip(rows, ids, strict=True))
    assert runs[0] == runs[1] and Counter(r[1:] for r in runs[0]) == want
    assert [r[0] for r in runs[0]] == np.cumsum([0, *(r[2] for r in runs[0][:-1])]).tolist()
    assert [r[1] or 0 for r in runs[0]] == sorted(d or 0 for d, _, _ in rows)


def test_token_output_of_nothing_and_its_bloom_filter(spark, rows):
    scratch = Scratch(spark, "test")
    at, empty = scratch.path("orc"), scratch.path("orc")
    token_output.write_tokens(frame(spark, rows).filter(F.lit(False)), empty)
    assert token_output.token_index(token_output.read_tokens(spark, empty), scratch).collect() == []
    token_output.write_tokens(frame(spark, rows), at)
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    file = token_output.read_tokens(spark, at).inputFiles()[0]
    reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(file), orc.OrcFile.readerOptions(conf))
    streams = reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()
    kinds = {(s.getKind().toString(), s.getColumn()) for s in streams}
    assert ("BLOOM_FILTER_UTF8", 1) in kinds and ("ROW_INDEX", 1) in kinds and ("BLOOM_FILTER_UTF8", 2) not in kinds


def test_token_counts(spark, rows):
    lengths = [len(i) for i in reference_ids([t or "" for _, t, _ in rows])]
    sums = token_counts.suffix_sums(token_counts.length_histogram(frame(spark, rows))).cache()
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n)
        assert (r.docs_ge, r.tokens_ge) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_le, r.truncated) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths))
    for limit in (0, 7, 64, 10**6):
        assert token_counts.truncated_total(sums, limit).first().total == sum(min(x, limit) for x in lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 0.95, 1.0]).collect():
        assert r.n_tokens == sorted(lengths)[int(np.ceil(r.share * len(lengths))) - 1]


def test_substring_dedup(spark, rows):
    found = substring_dedup.substring_dedup(frame(spark, rows)).collect()
    pairs = {(r.doc_id, r.partner_id) for r in found}
    docs = {r.doc_id for r in found}
    group = set(range(80, 86))
    assert group <= docs and all(any((i, j) in pairs for j in group - {i}) for i in group)
    assert {60, 61, 62} <= docs
    texts = {d: brute_words(t) for d, t, _ in rows}
    for r in found:
        a, b = texts[r.doc_id][r.first_word : r.end_word], texts[r.partner_id][r.partner_first : r.partner_end]
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        assert len(a) >= 50 and len(b) >= 50 and len(x & y) >= 0.75 * len(x | y)
    assert not docs & {90, 91, 92, 93, 94, 96}
    alone = {d for d, t, _ in rows if d < 60 and d not in (3, 5, 10)}
    assert not docs & alone


def test_passages_adjacent_in_one_text_and_apart_in_the_other():
    new = iter(np.random.default_rng(4).permutation(100_000).astype(np.uint64))
    run = lambda n: np.array([next(new) for _ in range(n)], np.uint64)
    p, q = run(46), run(46)
    joined, apart = np.concatenate([run(9), p, run(4), q, run(5)]), np.concatenate([run(70), q, run(80), p, run(3)])
    for x, y in ((joined, apart), (apart, joined)):
        found = substring_dedup.passages(x, y, 46, 75)
        assert {tuple(x[a:b]) for a, b, *_ in found} == {tuple(p), tuple(q)} == {tuple(y[c:d]) for _, _, c, d, _ in found}
    thin = run(90)  # an exact passage between places that agree too seldom
    other = thin.copy()
    for t in (thin, other):
        t[[i for i in range(90) if i % 4 == (3 if t is thin else 1)]] = run(len([i for i in range(90) if i % 4 == (3 if t is thin else 1)]))
    x, y = np.concatenate([thin, p, thin[::-1]]), np.concatenate([other, p, other[::-1]])
    assert any(a <= 90 and b >= 136 for a, b, *_ in substring_dedup.passages(x, y, 46, 75))


def planted(seed, groups, variants, edits):
    """Documents that hold edited copies of a 60-word passage amid other words: rows, and for each document its passage."""
    r = np.random.default_rng(seed)
    word = lambda: "w" + str(r.integers(0, 1 << 40))
    rows, own = [], {}
    for _ in range(groups):
        base = [word() for _ in range(60)]
        for v in range(variants):
            p = list(base)
            for at in r.choice(60, edits[v], replace=False):
                p[at] = word()
            text = [word() for _ in range(r.integers(5, 80))] + p + [word() for _ in range(r.integers(5, 80))]
            own[len(rows)] = (p, len(rows) // variants)
            rows.append((len(rows), " ".join(text), "s"))
    return rows, own


def qualifying(own):
    """Documents whose passage is similar to that of another one of their group."""
    sets = {d: shingles(" ".join(p)) for d, (p, _) in own.items()}
    out = defaultdict(set)
    for a in own:
        for b in own:
            if a < b and own[a][1] == own[b][1] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                out[a].add(b)
                out[b].add(a)
    return out


def test_substring_recall(spark):
    """Against brute force, by the number of edited words; clean documents have no row."""
    for edits in (0, 1, 2):
        rows, own = planted(edits, 150, 2, (0, edits))
        want = qualifying(own)
        found = {r.doc_id for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
        assert len(want) >= 30 and len(set(want) & found) >= 0.97 * len(want) and found <= set(own)


def test_substring_rounds_end_when_nothing_is_new(spark, monkeypatch):
    """Variants of one passage in which members find each other one round after the other; the last round finds nothing."""
    rows, own = planted(9, 6, 80, [4] * 40 + [1] * 20 + [2] * 20)
    want = qualifying(own)
    counts, verified = [], substring_dedup._verified

    def counted(*args):
        out = verified(*args)
        counts.append(out.count())
        return out

    monkeypatch.setattr(substring_dedup, "_verified", counted)
    found = {r.doc_id for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()}
    assert counts[-1] == 0 and len(counts) >= 4 and all(counts[:-1])
    assert len(found & set(want)) >= 0.9 * len(want) and found <= set(own)


@pytest.mark.parametrize("crowd", [64, 4])
def test_substring_members_that_the_first_lacks(spark, crowd, monkeypatch):
    """Two exact passages amid variants that are too different: each document that has a partner finds one."""
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rows, own = planted(7, 12, 24, [4] * 22 + [0, 0])
    want = qualifying(own)
    found = defaultdict(set)
    for r in substring_dedup.substring_dedup(frame(spark, rows).coalesce(1 if crowd == 4 else 3)).collect():
        found[r.doc_id].add(r.partner_id)
    exact = [d for d, (p, g) in own.items() if d % 24 >= 22]
    assert all(d in want for d in exact) and sum(bool(found[d]) for d in exact) >= 0.95 * len(exact)
    assert sum(bool(found[d]) for d in want) >= 0.9 * len(want)


def chains(seed, groups):
    """Rows of triples: two edits of a passage around it, each similar to the passage and not to the other one."""
    r = np.random.default_rng(seed)
    word = lambda: "w" + str(r.integers(0, 1 << 40))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(60)]
        for at in (20, None, 40):
            p = [word() if i == at else w for i, w in enumerate(base)]
            rows.append((len(rows), " ".join([word() for _ in range(30)] + p + [word() for _ in range(30)]), "s"))
    return rows


def test_substring_open_members_meet_covered_ones(spark):
    """A member that its run's first lacks finds a partner which the first has covered."""
    rows = chains(3, 300)
    assert {r.doc_id for r in substring_dedup.substring_dedup(frame(spark, rows)).collect()} == {d for d, _, _ in rows}


def test_substring_contexts_come_in_blocks(monkeypatch):
    """A text with more marks than a block has: each mark with its tokens to both sides."""
    monkeypatch.setattr(substring_dedup, "MARKS", 7)
    tokens = np.random.default_rng(1).integers(0, 1 << 62, 100).astype(np.uint64)
    marks = [[{"run": i, "at": i, "open": i % 3 == 0} for i in range(n)] for n in (50, 3)]
    kind = pa.list_(pa.struct([("run", pa.int64()), ("at", pa.int64()), ("open", pa.bool_())]))
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6]), pa.array([tokens.tobytes()] * 2), pa.array(marks, kind)], names=["node", "tokens", "marks"])
    out = list(substring_dedup._around(iter([batch])))
    assert max(b.num_rows for b in out) <= 14 * 2
    rows = [r for b in out for r in b.to_pylist()]
    assert {(r["node"], r["run"], r["at"], r["open"], r["way"]) for r in rows} == {(n, i, i, i % 3 == 0, w) for n, k in ((5, 50), (6, 3)) for i in range(k) for w in (-1, 1)}
    for r in rows:
        want = substring_dedup._at(tokens, np.array([r["at"]]) + r["way"] * substring_dedup.PLACES).astype(np.uint16)
        assert r["context"] == want.tobytes()


def test_compact_windows():
    r = np.random.default_rng(3)
    v, least = r.integers(0, 1 << 62, 120, dtype=np.uint64), 10
    seen = {(i, j): c for lo, c, hi in substring_dedup.windows(v, least) for i in range(lo, c + 1) for j in range(c, hi + 1)}
    for i in range(len(v)):
        for j in range(i + least - 1, len(v)):
            assert seen[i, j] == i + int(v[i : j + 1].argmin())


EMPTY = {
    "jaccard": lambda d: jaccard_join.jaccard_join(d),
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "lines": lambda d: line_dedup.line_dedup(d),
    "mix": lambda d: mixing.mix(d),
    "shard": lambda d: sharding.shard(d),
    "counts": lambda d: token_counts.suffix_sums(token_counts.length_histogram(d)),
    "substring": lambda d: substring_dedup.substring_dedup(d),
}


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables_and_null_ids(spark, name):
    empty = frame(spark, [(1, "a", "s")]).filter(F.lit(False))
    assert EMPTY[name](empty).collect() == []
    odd = frame(spark, [(None, "a b c d e f g", None), (None, None, None), (1, "a b c d e f g", "s")])
    assert len(EMPTY[name](odd).collect()) == {"counts": 2, "substring": 0}.get(name, 3)
