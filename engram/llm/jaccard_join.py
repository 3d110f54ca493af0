"""N-gram Jaccard join: T-occurrence search over distributed inverted lists.

Two sets of shingles x and y of similarity s or more share at least
T = ceil(s / (1 + s) * (|x| + |y|)) shingles, and so s * |x| of x's. Three steps
narrow the corpus down to small groups of sets, and each group is searched by
DivideSkip:

1. Every shingle of every set goes into an inverted list, in a few bytes: half
   a hash and the place of the set in its chunk. A list tells its chunks which
   sets met another one there. A set that met others in fewer than s * |x|
   lists links with nothing and is out; what is left are near copies and sets
   patched together from others.
2. The sets that are left learn how long the lists of their shingles are and
   order them from the shortest to the longest. Linked sets have a shingle in
   common among the first |x| - ceil(s * |x|) + 1 of the larger and the first
   |y| - ceil(2 * s / (1 + s) * |y|) + 1 of the smaller one. Lists of those
   shingles tie sets together into groups.
3. A task takes groups of bounded size and builds their inverted lists. For
   each set as the query, its long lists are put aside, the short ones are
   merged by counting, and candidates that occur often enough there are looked
   up in the long lists by binary search. A set is not compared with sets to
   which it is linked already.

A group above the bound is first compared with pivots, the sets with the longest
lists, which usually make it one class; if not, its sets are dealt into blocks,
and every two blocks are searched together.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch, small
from .text import digest, shingled, texts_of

#: Shingles of one chunk of sets, about, in the first and in the second step.
CHUNK_TOKENS, LEFT_TOKENS = 1_000_000, 250_000
#: Shingles of one bucket of lists, about, and of the groups that a task takes. A larger group is divided.
BUCKET_TOKENS, GROUP_TOKENS = 2_000_000, 400_000
#: Sets of one chunk that share a shingle are tied together there if they are more than this.
CROWD = 64
#: Rounds of pivots of a group above `GROUP_TOKENS`.
PIVOTS = 3
#: Sets in one chunk, at most; the place of a posting that stands for several sets of its chunk.
CHUNK_SETS = SEVERAL = (1 << 16) - 1
#: Lists put aside as long: T / (MU * log2(longest) + 1).
MU = 0.0085
_BYTES_PER_TOKEN = 5.5


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as planes of bytes, so that the leading bytes of sorted ones compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def _unpack(data: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def _columns(table: pa.Table, *kinds: type) -> list[np.ndarray]:
    """The packed columns of all rows (n, data) of `table`, in a row."""
    rows = [_unpack(d, n, *kinds) for n, d in zip(table.column("n").to_pylist(), table.column("data").to_pylist(), strict=True)]
    return [np.concatenate(c) for c in zip(*rows, strict=True)]


def _dealt(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending tokens: the buckets that occur, and where each begins and ends."""
    bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    lo = np.concatenate([[0], cuts])
    return bucket[lo].astype(np.int64), lo, np.concatenate([cuts, [len(tokens)]])


def _starts(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of `x` begin."""
    head = np.ones(len(x), bool)
    head[1:] = x[1:] != x[:-1]
    return np.flatnonzero(head)


def _new_chunk(seq: int) -> int:
    return TaskContext.get().partitionId() << 32 | seq


_SCAN = "doc_id bigint, node bigint, bucket bigint, chunk bigint, n bigint, data binary"


def _scan_row(**cols: list) -> pa.RecordBatch:
    size = max(map(len, cols.values()))
    kinds = {"doc_id": pa.int64(), "node": pa.int64(), "bucket": pa.int64(), "chunk": pa.int64(), "n": pa.int64(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(cols.get(k, [None] * size), t) for k, t in kinds.items()], names=list(kinds))


def _postings(chunk: int, nodes: list[int], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A chunk's sets (bucket -1), with the lists in which they meet within the chunk, and its postings by bucket of lists."""
    sizes = np.array([len(s) for s in sets], np.uint32)
    tokens, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, who = tokens[order], who[order]
    at = _starts(tokens)
    times = np.diff(at, append=len(tokens))
    met = np.bincount(who[np.repeat(times > 1, times)], minlength=len(sets)).astype(np.uint32)
    tokens, who = tokens[at], np.where(times > 1, np.uint16(SEVERAL), who[at])
    bucket, lo, hi = _dealt(tokens, buckets)
    key = tokens.astype(np.uint32)
    data = [_pack(key[a:b], who[a:b]) for a, b in zip(lo, hi, strict=True)]
    return _scan_row(
        bucket=[-1, *bucket.tolist()], chunk=[chunk] * (len(bucket) + 1), n=[len(sets), *(hi - lo).tolist()], data=[_pack(np.array(nodes, np.int64), sizes, met), *data]
    )


def _scan(k: int, buckets: int):
    """A row for each document, and each task's distinct sets in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, sets, size, seq = [], [], 0, 0
        for batch in batches:
            ns, own = [], []
            for _, tokens in shingled(texts_of(batch.column(1)), k):
                tokens = np.unique(tokens)
                d = digest(tokens)
                ns.append(len(tokens))
                own.append(d)
                if not len(tokens) or d in seen:
                    continue
                seen.add(d)
                nodes.append(d)
                sets.append(tokens)
                size += len(tokens)
                if size >= CHUNK_TOKENS or len(sets) == CHUNK_SETS:
                    yield _postings(_new_chunk(seq), nodes, sets, buckets)
                    nodes, sets, size, seq = [], [], 0, seq + 1
            yield _scan_row(doc_id=batch.column(0).to_pylist(), node=own, n=ns)
        if sets:
            yield _postings(_new_chunk(seq), nodes, sets, buckets)

    return run


_REPLY = "chunk bigint, bucket bigint, n bigint, data binary"


def _meet(table: pa.Table) -> pa.Table:
    """For each chunk of a bucket: in how many of the bucket's lists each of its sets meets one of another chunk."""
    key, who = _columns(table, np.uint32, np.uint16)
    chunk = np.repeat(np.arange(table.num_rows), table.column("n").to_numpy())
    order = np.argsort(key, kind="stable")
    at = _starts(key[order])
    times = np.diff(at, append=len(key))
    met = order[np.repeat(times > 1, times)]
    met = met[who[met] != SEVERAL]
    pair, lists = np.unique(chunk[met] << 16 | who[met], return_counts=True)
    own = pair >> 16
    lo = _starts(own)
    hi = np.append(lo[1:], len(own)) if len(lo) else lo
    data = [_pack(pair[a:b].astype(np.uint16), lists[a:b].astype(np.uint32)) for a, b in zip(lo, hi, strict=True)]
    chunks = table.column("chunk").to_numpy()[own[lo]]
    return pa.table({"chunk": chunks, "bucket": pa.array([0] * len(lo), pa.int64()), "n": (hi - lo).astype(np.int64), "data": pa.array(data, pa.binary())})


def _left(percent: int):
    """The sets of one chunk that met others in enough lists."""

    def run(table: pa.Table) -> pa.Table:
        own = table.column("bucket").to_numpy() == -1
        nodes, n, met = _columns(table.filter(pa.array(own)), np.int64, np.uint32, np.uint32)
        if not own.all():
            who, lists = _columns(table.filter(pa.array(~own)), np.uint16, np.uint32)
            met = met + np.bincount(who, weights=lists, minlength=len(nodes)).astype(np.int64)
        return pa.table({"node": nodes[100 * met.astype(np.int64) >= percent * n.astype(np.int64)]})

    return run


def _chunks(k: int):
    """The texts' distinct sets: a row (chunk, -1, n, sizes, nodes and sets) for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        nodes, sets, seq = [], [], 0

        def row() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.uint32)
            data = b"".join([np.array(nodes, np.int64).tobytes(), sizes.tobytes(), *(s.tobytes() for s in sets)])
            return pa.RecordBatch.from_arrays([pa.array([_new_chunk(seq)]), pa.array([-1]), pa.array([len(sets)]), pa.array([data], pa.binary())], names=["chunk", "bucket", "n", "data"])

        size = 0
        for batch in batches:
            for _, tokens in shingled(texts_of(batch.column(0)), k):
                tokens = np.unique(tokens)
                d = digest(tokens)
                if not len(tokens) or d in seen:
                    continue
                seen.add(d)
                nodes.append(d)
                sets.append(tokens)
                size += len(tokens)
                if size >= LEFT_TOKENS:
                    yield row()
                    nodes, sets, size, seq = [], [], 0, seq + 1
        if sets:
            yield row()

    return run


def _sets_of(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, sizes, shingles in a row) of a chunk's row."""
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.uint32, n, 8 * n), np.frombuffer(data, np.uint64, -1, 12 * n)


def _ask(buckets: int):
    """How often each shingle of a chunk occurs there, by bucket of lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "n", "data")), strict=True):
                tokens, times = np.unique(_sets_of(n, data)[2], return_counts=True)
                bucket, lo, hi = _dealt(tokens, buckets)
                key, times = tokens.astype(np.uint32), np.minimum(times, SEVERAL).astype(np.uint16)
                packed = [_pack(key[a:b], times[a:b]) for a, b in zip(lo, hi, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(lo)), pa.array(bucket), pa.array(hi - lo), pa.array(packed, pa.binary())], names=["chunk", "bucket", "n", "data"])

    return run


def _lengths(table: pa.Table) -> pa.Table:
    """The reply to each chunk of a bucket: log2 of the length of each list that it asked for."""
    key, times = _columns(table, np.uint32, np.uint16)
    _, at = np.unique(key, return_inverse=True)
    length = np.log2(np.bincount(at, weights=times)).astype(np.uint8)[at]
    ends = np.cumsum(table.column("n").to_numpy())
    data = [length[a:b].tobytes() for a, b in zip(ends - table.column("n").to_numpy(), ends, strict=True)]
    return table.select(["chunk", "bucket", "n"]).append_column("data", pa.array(data, pa.binary()))


_TIES, _SETS = -1, -2
_FIRST = "bucket bigint, n bigint, data binary"


def _first_lists(percent: int, buckets: int):
    """Of one chunk: postings of its sets' first shingles by bucket of lists, ties between sets, and (node, size, weight) of the sets that are still in."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("bucket", "n", "data")), strict=True))
        nodes, sizes, tokens = _sets_of(*rows[0][1:])
        names, at = np.unique(tokens, return_inverse=True)
        length = np.frombuffer(b"".join(r[2] for r in rows[1:]), np.uint8)[at]
        n, who = sizes.astype(np.int64), np.repeat(np.arange(len(nodes)), sizes)
        weight = np.bincount(who, weights=length, minlength=len(nodes)) / n
        stays = 100 * np.bincount(who, weights=length > 0, minlength=len(nodes)) >= percent * n
        order = np.lexsort((at, length, who))
        place = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        probe, index = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
        take = (place < probe[who]) & stays[who]
        own, token, first = who[take], names[at[order[take]]], (place < index[who])[take]
        order = np.lexsort((own, token))
        own, token, first = own[order], token[order], first[order]
        lo = _starts(token)
        times = np.diff(lo, append=len(token))
        crowd = np.repeat(times > CROWD, times)
        head = np.zeros(len(token), bool)
        head[lo] = True
        ties = _pack(nodes[own[np.repeat(lo, times)[crowd]]], nodes[own[crowd]])
        if len(lo):
            first[lo] |= np.logical_or.reduceat(first, lo) & (times > CROWD)
        sent = ~crowd | head
        own, token, first = own[sent], token[sent], first[sent]
        kept = np.flatnonzero(stays)
        out = [(_TIES, int(crowd.sum()), ties), (_SETS, len(kept), _pack(nodes[kept], n[kept], weight[kept]))]
        if len(token):
            out += [(b, z - a, _pack(token[a:z], nodes[own[a:z]], first[a:z].astype(np.uint8))) for b, a, z in zip(*(x.tolist() for x in _dealt(token, buckets)), strict=True)]
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "n", "data"])

    return run


def _tie(table: pa.Table) -> pa.Table:
    """Ties (u, v) between the sets of each list of a bucket that is among the first of a smaller set; u is a list's first set."""
    token, node, first = _columns(table, np.uint64, np.int64, np.uint8)
    order = np.lexsort((node, token))
    token, node, first = token[order], node[order], first[order]
    lo = _starts(token)
    times = np.diff(lo, append=len(token))
    in_first = np.repeat(np.logical_or.reduceat(first > 0, lo), times) if len(lo) else np.zeros(0, bool)
    u = np.repeat(node[lo], times)
    both = np.unique(np.stack([u, node], axis=1)[in_first & (u != node)], axis=0)
    return pa.table({"u": both[:, 0].copy(), "v": both[:, 1].copy()})


def _unpacked(schema: list[tuple[str, type]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack(data, n, *(t for _, t in schema))], names=[c for c, _ in schema])

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (node, tokens) for each set of the chunks."""
    for batch in batches:
        for n, data in zip(batch.column("n").to_pylist(), batch.column("data").to_pylist(), strict=True):
            nodes, sizes, tokens = _sets_of(n, data)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([tokens[a:b].tobytes() for a, b in zip(ends - sizes, ends, strict=True)], pa.binary())], names=["node", "tokens"])


def divide_skip(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between `sets` (ascending by size) that join all those which links connect; sets of one `label` are taken as linked.

    Each set is the query for the sets before it. T is the least overlap with a
    set of an allowed size; `apart` of its lists are long, and a candidate
    occurs at least T - apart times in the short ones, which are merged at once
    in arrays: a query's lists hold no more than its group.
    """
    count = len(sets)
    sizes = [len(s) for s in sets]
    label = np.arange(count) if label is None else label.copy()
    members: dict[int, list[int]] = {}
    for i, c in enumerate(label.tolist()):
        members.setdefault(c, []).append(i)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    who = np.repeat(np.arange(count, dtype=np.int32), sizes)
    order = np.lexsort((who, flat))
    ids, flat = who[order], flat[order]
    lo = _starts(flat)
    begin = np.repeat(lo, np.diff(lo, append=len(flat)))
    at = np.argsort(ids, kind="stable")  # postings of each set in turn
    at = at[begin[at] < at]  # where an earlier set is in the list
    bounds = np.searchsorted(ids[at], np.arange(count + 1)).tolist()
    size_of, links = np.array(sizes, np.int64), []

    def merged(first: np.ndarray, width: np.ndarray, q: int) -> np.ndarray:
        """How often each set before q occurs in the lists that begin at `first`."""
        place = np.repeat(first - (np.cumsum(width) - width), width) + np.arange(width.sum())
        return np.bincount(ids[place], minlength=q)

    for q in range(count):
        least = -(-percent * sizes[q] // 100)
        if bounds[q + 1] - bounds[q] < least:
            continue
        ends = at[bounds[q] : bounds[q + 1]]
        width = ends - begin[ends]
        ends = ends[np.argsort(width, kind="stable")]
        first, width = begin[ends], np.sort(width)
        apart = min(least - 1, int(least / (MU * log2(width[-1]) + 1)))
        short = len(ends) - apart
        times = merged(first[:short], width[:short], q)
        y = np.flatnonzero(times >= least - apart)
        y = y[(y >= bisect_left(sizes, least)) & (label[y] != label[q])]
        if not len(y):
            continue
        if len(y) * apart < width[short:].sum():
            long = np.sort(flat[ends[short:]])
            found = times[y] + [int((sets[i][np.minimum(np.searchsorted(sets[i], long), sizes[i] - 1)] == long).sum()) for i in y.tolist()]
        else:  # as many candidates as a list has sets: one merge costs less
            found = (times + merged(first[short:], width[short:], q))[y]
        for i in y[found >= -(-percent * (sizes[q] + size_of[y]) // (100 + percent))].tolist():
            if label[i] != label[q]:
                links.append((i, q))
                keep, gone = sorted((int(label[i]), int(label[q])), key=lambda c: -len(members[c]))
                label[members[gone]] = keep
                members[keep] += members.pop(gone)
    return links


_LINKS = "a bigint, b bigint"


def _search(percent: int):
    """Links within the groups of a task; of rows (group, node, class, tokens), those of one class are taken as linked."""

    def run(table: pa.Table) -> pa.Table:
        group, node, known = (table.column(c).to_numpy() for c in ("group", "node", "class"))
        tokens = table.column("tokens")
        order = np.lexsort((node, group))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (node[order][1:] != node[order][:-1]) | (group[order][1:] != group[order][:-1])
        order = order[fresh]
        out = []
        for rows in np.split(order, _starts(group[order])[1:]):
            sets = [np.frombuffer(tokens[i].as_py(), np.uint64) for i in rows.tolist()]
            by_size = sorted(range(len(sets)), key=lambda i: len(sets[i]))
            ids = node[rows[by_size]]
            out += [(int(ids[x]), int(ids[y])) for x, y in divide_skip([sets[i] for i in by_size], percent, np.unique(known[rows[by_size]], return_inverse=True)[1])]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return run


def _probe(percent: int):
    """The rows (a, b, x, y) whose sets x and y link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _large_groups(sets: DataFrame, large: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) in the groups of `large` (node, group, tokens_in, weight), which no task takes whole; `sets` is (node, tokens)."""
    rest, links = scratch.table(sets.join(large, "node"), "large"), None
    for _ in range(PIVOTS):
        pivots = rest.groupBy("group").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
        pivots = scratch.table(pivots.join(rest.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b").dropDuplicates(["b"]), "pivots")
        width = pivots.agg(F.max(F.length("y"))).first()[0]
        if width is None:
            break
        tried = rest.join(small(pivots, width + 24), "group").select(F.col("node").alias("a"), "b", F.col("tokens").alias("x"), "y")
        found = scratch.table(tried.mapInArrow(_probe(percent), _LINKS), "links")
        links = found if links is None else links.union(found)
        rest = scratch.table(rest.join(found.select(F.col("a").alias("node")).distinct(), "node", "left_anti"), "rest")
    classes = connected_components(links, scratch).select("node", F.col("label").alias("class"))
    known = scratch.table(sets.join(large, "node").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")), "known")
    open_ = known.groupBy("group").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo < hi").select("group")
    blocks = F.greatest(F.lit(2), F.ceil(2 * F.col("tokens_in") / GROUP_TOKENS)).cast("int")
    rows = known.join(open_, "group").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("own <> other").withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    found = cells.select("group", "i", "j", "node", "class", "tokens").groupBy("group", "i", "j").applyInArrow(_search(percent), _LINKS)
    return links.union(scratch.table(found, "links"))


def _candidates(docs: DataFrame, k: int, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row of `docs`, and the nodes that meet others in enough lists."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / _BYTES_PER_TOKEN / BUCKET_TOKENS))
    scanned = scratch.table(docs.mapInArrow(_scan(k, buckets), _SCAN), "scan")
    rows = scratch.table(scanned.filter("chunk is null").select("doc_id", "n", "node"), "rows")
    chunks = scanned.filter("chunk is not null").select("chunk", "bucket", "n", "data")
    replies = chunks.filter("bucket >= 0").groupBy("bucket").applyInArrow(_meet, _REPLY)
    left = chunks.filter("bucket = -1").union(replies).groupBy("chunk").applyInArrow(_left(percent), "node bigint")
    left = scratch.table(left.distinct(), "left")
    scratch.drop(scanned)
    return rows, left


def _groups(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, n, weight, group) of the sets in chunks that lists of their first shingles tie to others."""
    spark = sets.sparkSession
    size = sets.agg(F.sum(F.length("data"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(size / 8 / BUCKET_TOKENS))
    replies = sets.mapInArrow(_ask(buckets), _REPLY).groupBy("bucket").applyInArrow(_lengths, _REPLY)
    lists = sets.union(replies).groupBy("chunk").applyInArrow(_first_lists(percent, buckets), _FIRST)
    lists = scratch.table(lists, "lists")
    ties = lists.filter("bucket >= 0").groupBy("bucket").applyInArrow(_tie, "u bigint, v bigint")
    ties = ties.union(lists.filter(f"bucket = {_TIES}").mapInArrow(_unpacked([("u", np.int64), ("v", np.int64)]), "u bigint, v bigint"))
    groups = connected_components(ties, scratch).select("node", F.col("label").alias("group"))
    measures = lists.filter(f"bucket = {_SETS}").mapInArrow(_unpacked([("node", np.int64), ("n", np.int64), ("weight", np.float64)]), "node bigint, n bigint, weight double")
    return scratch.table(measures.dropDuplicates(["node"]).join(groups, "node"), "groups")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, group_size) for every row of `docs` (doc_id, text; other columns are not read).

    Two documents link when 100 * |x & y| >= percent * |x | y| for their sets of
    k-word shingles; component_id is the smallest doc_id reachable by links.
    Null and empty texts have an empty set and are alone. Repeated rows and
    equal texts are in one component. A row with a null doc_id is returned with
    a null component_id and takes no part. An empty table gives an empty result.
    Sets are compared by 64-bit shingle hashes.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows, left = _candidates(docs, k, percent, scratch)
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = scratch.table(classes, "classes")

    ids = scratch.table(classes.join(left, "node").select(F.col("rep").alias("doc_id")), "ids")
    sets = scratch.table(docs.join(small(ids, 16), "doc_id", "left_semi").select("text").mapInArrow(_chunks(k), _REPLY), "sets")
    groups = _groups(sets, percent, scratch)
    sizes = groups.groupBy("group").agg(F.sum("n").alias("tokens_in"))
    sizes = scratch.table(sizes, "sizes")
    tasks = max(1, ceil((sizes.filter(F.col("tokens_in") <= GROUP_TOKENS).agg(F.sum("tokens_in")).first()[0] or 0) / GROUP_TOKENS))
    dealt = groups.join(sizes.filter(F.col("tokens_in") <= GROUP_TOKENS), "group").select("node", "group", F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("task"))
    dealt = scratch.table(dealt, "dealt")
    single = sets.mapInArrow(_single, "node bigint, tokens binary")
    members = single.join(small(dealt, 32), "node").select("task", "group", "node", F.col("node").alias("class"), "tokens")
    links = scratch.table(members.groupBy("task").applyInArrow(_search(percent), _LINKS), "links")
    large = sizes.filter(F.col("tokens_in") > GROUP_TOKENS)
    if not large.isEmpty():
        links = links.union(_large_groups(single, scratch.table(groups.join(large, "group").select("node", "group", "tokens_in", "weight"), "large"), percent, scratch))
    label = scratch.table(connected_components(links, scratch), "labels")

    named = classes.join(label, "node", "left").select("node", "rep", "copies", F.coalesce("label", "node").alias("label"))
    groups = named.groupBy("label").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("group_size"))
    named = scratch.table(named.join(groups, "label").select("node", "component_id", "group_size"), "named")
    out = rows.join(named, "node", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
        F.when(alone | F.col("doc_id").isNull(), F.lit(1).cast("bigint")).otherwise(F.col("group_size")).alias("group_size"),
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def one_of_each_group(docs: DataFrame, **kw) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; rows with a null doc_id stay, and so do all rows of a doc_id that stays."""
    joined = jaccard_join(docs, **kw)
    scratch = Scratch(docs.sparkSession, "keep")
    drop = scratch.table(joined.filter("doc_id <> component_id").select("doc_id").distinct(), "drop")
    return docs.join(small(drop, 16), "doc_id", "left_anti").select(docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, count(DISTINCT reach.b)::BIGINT AS group_size
FROM documents d JOIN reach ON reach.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
