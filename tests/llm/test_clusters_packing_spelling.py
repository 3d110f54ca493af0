"""Clustering, packing and spelling variants against brute force, with the cases that the docstrings define."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from engram.llm import clustering, packing, spelling
from engram.llm.scratch import Scratch
from tests.llm.conftest import SCHEMA, frame

VECTORS = "vec_id bigint, embedding array<float>, v string, cluster int, distance int"


def brute_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1])
    centroids = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        centroids = [tuple(sum(col) // len(groups[c]) for col in zip(*groups[c], strict=True)) if c in groups else old for c, old in enumerate(centroids)]
    out = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in kept]
    inertia = Counter()
    for _, c, d in out:
        inertia[c] += d
    return sorted((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out if i is not None), len(out)


@pytest.mark.parametrize("k, dims", [(1, 2), (5, 2), (16, 3), (400, 3)])
def test_clusters_equal_plain_search(spark, k, dims):
    r = random.Random(k)
    rows = [(i, [r.choice([-1.5, -0.75, 0.0, 0.3, 1.0]) + (i % 3) for _ in range(dims)]) for i in range(120)]  # many ties and equal vectors
    rows += [rows[4], rows[4], (3, [9.0] * dims), (None, [0.5] * dims), (None, [0.5] * dims)]
    bad = [(200, None), (201, []), (202, [1.0] * (dims + 1)), (203, [float("nan")] + [0.0] * (dims - 1)), (204, [float("-inf")] * dims), (205, [None] + [0.0] * (dims - 1))]
    df = spark.createDataFrame([(i, v, "x", 7, 7) for i, v in rows + bad], VECTORS).repartition(3)
    got = [tuple(x) for x in clustering.cluster(df, k, 3, dims, 2, 9).collect()]
    want, n = brute_clusters(rows, k, 3, dims, 2, 9)
    assert sorted(x for x in got if x[0] is not None) == want
    assert len(got) == n


def test_search_keeps_exact_state_over_rounds():
    """Bounds carried over many rounds never lose the nearest centroid, and most vectors end up unseen."""
    r = np.random.default_rng(3)
    x = r.integers(-40, 40, (600, 4)) + 200 * r.integers(0, 6, (600, 1))
    points = x[:24].copy()
    nearest, second, upper, lower = np.zeros(600, np.int64), np.ones(600, np.int64), np.full(600, np.inf), np.zeros(600)
    old = None
    for _ in range(12):
        new = clustering.Centroids(points)
        moved, others = clustering._moves(old, new)
        upper += moved[nearest]
        lower -= others[nearest]
        new.assign(x, nearest, second, upper, lower)
        all_ = ((x[:, None] - points[None]) ** 2).sum(axis=2)
        assert (nearest == all_.argmin(axis=1)).all()
        ordered = np.sort(all_, axis=1)
        assert (lower <= np.sqrt(ordered[:, 1]) + 1e-6).all()
        assert (upper >= np.sqrt(ordered[:, 0]) - 1e-6).all()
        points = np.array([x[nearest == c].sum(axis=0) // max((nearest == c).sum(), 1) if (nearest == c).any() else points[c] for c in range(24)])
        old = new


def test_no_vectors_and_vectors_too_large(spark):
    assert clustering.cluster(spark.createDataFrame([], VECTORS)).collect() == []
    assert clustering.cluster(spark.createDataFrame([(1, None, "", 0, 0)], VECTORS)).collect() == []
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30, 0.0], "", 0, 0)], VECTORS), dims=2).collect()


def test_fill_comes_closest():
    r = random.Random(5)
    for _ in range(300):
        lengths = sorted({r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(1, 6))}.items(), reverse=True)
        capacity = r.randint(1, 90)
        sums = {sum(x * t for (x, _), t in zip(lengths, times, strict=True)) for times in itertools.product(*(range(c + 1) for _, c in lengths))}
        got = packing.fill(lengths, capacity)
        assert sum(x * t for x, t in got) == max(s for s in sums if s <= capacity)
        assert all(0 < t <= dict(lengths)[x] for x, t in got)


@pytest.mark.parametrize("window, pool", [(2048, 512), (64, 3)])
def test_packing_covers_every_id_once(spark, rows, window, pool):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    more = [*rows, (None, "no id at all", "s1"), (None, "no id at all", "s1")]
    got = packing.pack(frame(spark, more), window=window, pool=pool).collect()
    of, left = defaultdict(list), Counter()
    for i, t, _ in more:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        of[i].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in got:
        assert p.doc_tokens == len(of[p.doc_id][0])
        ids = of[p.doc_id][0][p.start : p.start + p.length]
        assert p.length == len(ids) > 0
        assert p.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
        left[p.doc_id] += p.length
    assert {i: n for i, n in left.items()} == {i: sum(map(len, d)) for i, d in of.items()}
    for i, found in pieces.items():  # each place as often as the row is there
        times = Counter(at for p in found for at in range(p.start, p.start + p.length))
        assert set(times.values()) == {len(of[i])}
    assert sorted(sequences) == list(range(len(sequences)))
    for found in sequences.values():
        at = 0
        for p in sorted(found, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or (at < window and at & (at - 1) == 0)
    assert packing.pack(frame(spark, [])).collect() == []


def test_no_gap_and_hardly_a_cut_while_the_pool_lasts():
    r = random.Random(1)
    packer = packing.Packer(2048)
    for i in range(4000):
        packer.document(i, np.ones(min(2047, int(r.expovariate(1 / 500)) + 1), "<u4"))
        while packer.held > 512:
            packer.pack()
    used, cut = Counter(), 0
    for _, start, length, _, total, seq, _ in packer.rows:
        cut += length < total
        used[seq] += length
    assert set(used.values()) == {2048}
    assert cut <= 8


def brute_variants(docs, least, count, ratio, every):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    forms, nears = {}, {}
    for w, c in n.items():
        found = [x for x in n if near(w, x)]
        best = min(found, key=lambda x: (-n[x], x), default=None)
        nears[w] = len(found)
        forms[w] = best if best is not None and n[best] >= ratio * c else None

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, forms[w], root(w), c, nears[w], n[forms[w]] if forms[w] else None) for w, c in n.items())


def variants_corpus(r):
    vocab = ["".join(r.choice("abcdefàß") for _ in range(r.randint(5, 8))) for _ in range(60)] + ["abcdef", "abcdeg", "abdcef", "abcdefa", "ÀBCDEF"]
    vocab += [w[:i] + r.choice("abcdé") + w[i + 1 :] for w in vocab[:40] for i in (0, len(w) // 2)] + [w + "a" for w in vocab[:20]]
    docs = [(i, " ".join(r.choices(vocab, [1 + 40 / (k + 1) for k in range(len(vocab))], k=80)) + ", " + "It's ÀBCDEF÷end 'Abcdef' x東京abcdefЖ") for i in range(60)]
    return docs + [(90, None), (91, ""), (92, "y" * 5000 + " " + "y" * 4999 + "z " + ("y" * 5000 + "\n") * 6), docs[3], docs[3], (None, "abcdefgh " * 9), (None, "abcdefgh abcdefgi")] + [(100 + i, "abcdefgi " * 2) for i in range(5)]


@pytest.mark.parametrize("sizes", [{}, {"cell": 6, "sample": 50, "task_words": 4, "task_queries": 9}])
def test_variants_equal_brute_force(spark, sizes):
    docs = variants_corpus(random.Random(11))
    for every in (199, 7):
        got = spelling.spelling_variants(frame(spark, [(i, t, "s") for i, t in docs]), least_count=2, ratio=2, every=every, **sizes).collect()
        assert sorted(tuple(x) for x in got) == brute_variants(docs, 6, 2, 2, every)
    assert {x.form for x in got} - {None}


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert spelling.spelling_variants(frame(spark, [(1, None, "s"), (2, "", "s"), (3, "too short", "s")])).collect() == []


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w5"), ("b", "w0")]
    got = dict(spelling.roots(spark.createDataFrame(chain, "word string, form string"), Scratch(spark, "chain")).collect())
    assert got == {w: "w37" for w, _ in chain}


def test_tree_reaches_every_neighbour():
    """Boxes of both kinds never rule out a point that is near enough, and leave most others out."""
    r = random.Random(2)
    words = list({"".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(1500)})
    at = spelling.points([w.encode() for w in words])
    for tight in (True, False):
        tree = spelling.Tree(at, 12, tight)
        reached, seen = set(), 0
        for _, mine, theirs in tree.reached(at[:200], 1, 1):
            seen += len(mine) * len(theirs)
            reached |= {(int(q), int(p)) for q in theirs for p in mine}
        up, down = spelling._apart(at[:200, None], at[None], at[None])
        assert {(int(a), int(b)) for a, b in zip(*np.nonzero((up <= 1) & (down <= 1)), strict=True)} <= reached
        assert seen < 0.5 * 200 * len(words)
    assert (spelling.Tree(at[:700], 12, False).home(at[:700]) >= 0).all()
