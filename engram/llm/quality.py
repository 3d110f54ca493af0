"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one weight vector w for all
grades and ordered thresholds. x is a document's set of hashed words and of
binned shape measures (share of capitals, symbols, digits, distinct words, ...).
An L1 penalty keeps few weights, so only they travel to the tasks.

The model is fitted on a bounded sample of the labelled rows (`MAX_TRAIN`, by
MD5 of doc_id); every document is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import Words, chunks, mix, texts_of

#: Labelled rows used for fitting, at most.
MAX_TRAIN = 6000
FEATURE_BITS = 26
GRADES = 3
KEEP_GRADE = 2
KEEP_PROBABILITY = 0.5
_BINS = 12


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[65:91] = 1  # capitals
    kind[97:123] = 2
    kind[48:58] = 3  # digits
    kind[[32, 9, 10, 11, 12, 13]] = 4
    kind[128:] = 2
    kind[[44, 46]] = 5  # comma, full stop
    return kind


_KIND = _classes()


def _shapes(w: Words, ends: np.ndarray) -> np.ndarray:
    """Binned shape measures of each text of a chunk, as feature numbers."""
    kind = _KIND[w.buf]
    counts = []
    for k in range(6):
        total = np.concatenate([[0], np.cumsum(kind == k)])
        counts.append(total[ends] - total[np.concatenate([[0], ends[:-1] + 1])])
    symbols, capitals, letters, digits, _, stops = (np.asarray(c, float) for c in counts)
    size = np.maximum(symbols + capitals + letters + digits + stops, 1)
    words = np.diff(w.bounds).astype(float)
    row = np.repeat(np.arange(len(words)), np.diff(w.bounds))
    order = np.lexsort((w.hashes, row))
    h, r = w.hashes[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[fresh], minlength=len(words)).astype(float)
    runs = np.diff(np.concatenate([np.flatnonzero(fresh), [len(h)]]))
    most = np.zeros(len(words))
    np.maximum.at(most, r[fresh], runs)
    again = np.zeros(len(words))
    if len(w.hashes) > 1:
        same = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
        again += np.bincount(row[1:][same], minlength=len(words))
    w1 = np.maximum(words, 1)
    shares = [symbols / size, capitals / size, digits / size, stops / size, most / w1, again / w1]
    parts = [np.ceil(-np.log2(np.clip(s, 2.0 ** -(_BINS - 2), 1))) + (s == 0) for s in shares]
    parts.append(np.floor(np.log2(w1)))
    parts.append(np.round(np.clip(np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)), 0, 1) * 20))
    parts.append(np.clip(np.round(size / w1), 0, 20))
    codes = [(j + 1) * 64 + np.clip(p, 0, 63) for j, p in enumerate(parts)]
    return mix(np.stack(codes, axis=1).astype(np.uint64) + np.uint64(1 << 40)) & np.uint64((1 << FEATURE_BITS) - 1)


def _chunk(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) of a chunk of texts, unsorted duplicates of words kept."""
    w = Words(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    row = np.repeat(np.arange(len(texts)), np.diff(w.bounds))
    shapes = _shapes(w, ends)
    feature = np.concatenate([w.hashes & np.uint64((1 << FEATURE_BITS) - 1), shapes.ravel()]).astype(np.int64)
    return np.concatenate([row, np.repeat(np.arange(len(texts)), shapes.shape[1])]), feature


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, out = texts_of(batch.column("text")), []
        for lo, hi in chunks(texts):
            row, feature = _chunk(texts[lo:hi])
            pair = np.unique(row << FEATURE_BITS | feature)
            cuts = np.searchsorted(pair, np.arange(hi - lo + 1) << FEATURE_BITS)
            own = (pair & ((1 << FEATURE_BITS) - 1)).astype(np.uint32)
            out += [own[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(out, pa.binary())], names=["grade", "features"])


@dataclass
class Model:
    """Non-zero weights by feature, in ascending order of feature, and the ordered thresholds."""

    feature: np.ndarray
    weight: np.ndarray
    threshold: np.ndarray

    def score(self, texts: list[bytes]) -> np.ndarray:
        """w . x of whole texts."""
        out = np.zeros(len(texts))
        if not len(self.feature):
            return out
        for lo, hi in chunks(texts):
            row, feature = _chunk(texts[lo:hi])
            at = np.minimum(np.searchsorted(self.feature, feature), len(self.feature) - 1)
            hit = self.feature[at] == feature
            pair = np.unique(row[hit] * len(self.feature) + at[hit])
            out[lo:hi] = np.bincount(pair // len(self.feature), weights=self.weight[pair % len(self.feature)], minlength=hi - lo)
        return out

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... for each score, a column each."""
        return 1 / (1 + np.exp(np.clip(self.threshold[None, :] - score[:, None], -40, 40)))


def fit(grades: np.ndarray, features: list[np.ndarray], steps: int = 400, rate: float = 0.05, penalty: float = 1e-4, least_docs: int = 4) -> Model:
    """Maximum likelihood with an L1 penalty, by Adam with soft thresholding; grades count equally whatever their frequency."""
    lengths = np.array([len(f) for f in features], np.int64)
    flat = np.concatenate(features) if len(features) else np.zeros(0, np.uint32)
    names, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    keep = df[at] >= least_docs
    row = np.repeat(np.arange(len(features)), lengths)[keep]
    names, at = np.unique(flat[keep], return_inverse=True)
    y = grades.astype(int)
    share = np.bincount(y, minlength=GRADES) / max(len(y), 1)
    c = 1 / np.maximum(share[y], 1e-9) / max((share > 0).sum(), 1) / max(len(y), 1)
    cuts = GRADES - 1
    w, t = np.zeros(len(names)), np.linspace(-1, 1, cuts)
    m, v = np.zeros(len(names) + cuts), np.zeros(len(names) + cuts)
    for step in range(1, steps + 1 if len(y) else 1):
        s = np.bincount(row, weights=w[at], minlength=len(y))
        below = 1 / (1 + np.exp(-np.clip(np.concatenate([t, [np.inf]])[None, :] - s[:, None], -40, 40)))
        below[:, -1] = 1
        hi, lo = below[np.arange(len(y)), y], np.where(y > 0, below[np.arange(len(y)), y - 1], 0)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = c * (dhi - dlo) / p  # of -log p by score
        gt = np.array([-(c * ((y == k) * dhi - (y == k + 1) * dlo) / p).sum() for k in range(cuts)])
        g = np.concatenate([np.bincount(at, weights=gs[row], minlength=len(names)), gt])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-4)
        shrink = rate * penalty / (np.sqrt(v[: len(names)] / (1 - 0.99**step)) + 1e-4)
        w = w - move[: len(names)]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        t = np.sort(t - move[len(names) :])
    used = w != 0
    return Model(names[used].astype(np.int64), w[used], t)


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """0: toxic; 1: poor; 2: good."""
    return F.when(F.col(toxic) > 0, 0).when(F.col(quality) > 0, 2).otherwise(1)


def train(docs: DataFrame, ratings: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on the rows of `docs` (doc_id, text) with a grade in `ratings` (doc_id, grade), `max_train` doc_ids at most.

    Of a doc_id's ratings the lowest counts, and of its rows the one with the
    smallest hash of the text. Null doc_ids and grades take no part; null and
    empty texts have their shape alone. Without ratings the model keeps what its
    first thresholds keep. Ratings are taken by MD5 of doc_id, so the fitted
    rows depend on the tables alone.
    """
    some = ratings.filter("doc_id is not null and grade is not null").select("doc_id", "grade").orderBy(F.md5(F.col("doc_id").cast("string")), "grade").limit(max_train)
    some = Scratch(docs.sparkSession, "ratings").table(some.groupBy("doc_id").agg(F.min("grade").alias("grade")), "sample")
    rated = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    one = rated.groupBy("doc_id").agg(F.min_by(F.struct("grade", "text"), F.xxhash64("text")).alias("r")).select("r.grade", "r.text")
    rows = one.mapInArrow(_features, "grade int, features binary").toPandas()
    rows = rows.sort_values(["grade", "features"], ignore_index=True)
    return fit(rows["grade"].to_numpy(int), [np.frombuffer(f, np.uint32) for f in rows["features"]])


def _score(model: Model, least: float, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tails = model.tails(model.score(texts_of(batch.column("text"))))
            good = tails[:, KEEP_GRADE - 1] >= least
            if keep:
                yield batch.filter(pa.array(good))
                continue
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tails.sum(axis=1)), pa.array(tails[:, KEEP_GRADE - 1].copy()), pa.array(good)], names=["doc_id", "expected_grade", "tail_probability", "kept"])

    return run


def score(docs: DataFrame, model: Model, least: float = KEEP_PROBABILITY) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) for every row of `docs` (doc_id, text).

    tail_probability: that the grade is `KEEP_GRADE` or better; kept: it is
    `least` or more. Null and empty texts are scored on their shape alone; null
    doc_ids and repeated rows are returned as they come.
    """
    schema = "doc_id bigint, expected_grade double, tail_probability double, kept boolean"
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_score(model, least, keep=False), schema)


def select(docs: DataFrame, model: Model, least: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns; each row by itself, so nulls, repeated rows and empty tables need no rule."""
    return docs.mapInArrow(_score(model, least, keep=True), docs.schema)


def ratings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality is not null and toxic is not null")
    return labels.select("doc_id", grade_of().cast("int").alias("grade"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, ratings_of(spark, sf_dir))).filter("kept")
