"""Toxicity grades by cumulative-link ordinal regression.

The severity of a document is one weighted sum of sparse text features; ordered thresholds on it, which share the
weights, give P(grade <= k) = sigmoid(threshold_k - score). From these come the expected severity, the most
probable grade and the verdict P(grade >= 1) > ``reject``.

Features of a document are its distinct lower-cased words (punctuation at the ends removed) and the prefixes of four
and five letters of these words, hashed to ``BUCKETS``; their value is the number of distinct words. A document's
score is thus a sum over its distinct words.

The model is fitted on a sample of at most ``per_class`` labelled documents of each of the two values of ``toxic``
(those with the smallest hash of their id, a bound that does not grow); grades are 0 (not toxic), 1 (toxic) and 2
(toxic and of low quality). Features are the ``FEATURES`` of the sample with the strongest association with toxicity.
Every document is scored where it lies: no shuffle, memory of one text, whole texts.

Defined results: a null text is the empty text, whose score is zero; a null id is kept; repeated rows are scored
each; several labels of one document count as their highest; without labels, or with one class only, nothing is
rejected; an empty table gives an empty result; extra columns are ignored by ``grade`` and kept by ``keep_clean``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import text_of

BUCKETS = 1 << 18
PER_CLASS = 4000
FEATURES = 4096
GRADES = 3
CACHE_WORDS = 400_000
EDGES = ".,;:!?()[]{}\"'#&%*$|-_<>/\\"


def word_features(word: str) -> list[int]:
    """Hashed features of one word."""
    word = word.strip(EDGES)
    if not word:
        return []
    digest = xxhash.xxh32_intdigest
    found = [digest(word.encode(), 0)]
    found += [digest(word[:n].encode(), n) for n in (4, 5) if len(word) >= n]
    return [h % BUCKETS for h in found]


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and their counts over distinct words."""
    return np.unique(np.array([f for w in set(text.lower().split()) for f in word_features(w)], np.int64), return_counts=True)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """Weights by feature bucket and rising thresholds, one fewer than there are grades."""

    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """P(grade) by row."""
        below = sigmoid(self.thresholds[None, :] - scores[:, None])
        edges = np.concatenate([np.zeros((len(scores), 1)), below, np.ones((len(scores), 1))], axis=1)
        return np.diff(edges, axis=1)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, buckets: int = BUCKETS, n_features: int = FEATURES, n_grades: int = GRADES, steps: int = 600, penalty: float = 1.0, least_z: float = 6.0, weight: float = 0.3) -> Ordinal:
    """Maximum penalised likelihood by full-batch gradient steps with momentum. ``least_z``: association that a
    feature needs; ``weight``: share of the toxic documents in the likelihood, as they are few."""
    cut = n_grades - 1
    nothing = Ordinal(np.zeros(buckets, np.float32), np.arange(cut) + 20.0)
    if len(np.unique(grades > 0)) < 2:
        return nothing
    row = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    feature = np.concatenate([f for f, _ in rows])
    value = 1 + np.log(np.concatenate([c for _, c in rows]))
    bad = grades[row] > 0
    n_bad, n_good = (grades > 0).sum(), (grades == 0).sum()
    with_bad, with_good = np.bincount(feature[bad], minlength=buckets), np.bincount(feature[~bad], minlength=buckets)
    share = (with_bad + with_good) / len(rows)
    z = (with_bad / n_bad - with_good / n_good) / np.sqrt(share * (1 - share) * (1 / n_bad + 1 / n_good) + 1e-9)
    chosen = np.argsort(-np.abs(z), kind="stable")[:n_features]
    chosen = chosen[np.abs(z[chosen]) > least_z]
    place = np.full(buckets, -1)
    place[chosen] = np.arange(len(chosen))
    use = place[feature] >= 0
    row, column, value = row[use], place[feature[use]], value[use]
    each = np.where(grades > 0, weight / n_bad, (1 - weight) / n_good)
    penalty = penalty / len(grades)
    # thresholds: the first, then logarithms of the gaps to the next
    p = np.concatenate([np.zeros(len(chosen)), [1.0], np.zeros(cut - 1)])
    mean, square = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, gaps = p[:len(chosen)], np.exp(p[len(chosen) + 1:])
        thresholds = p[len(chosen)] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(row, w[column] * value, len(grades))
        edge = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper, lower = sigmoid(edge[grades + 1] - score), sigmoid(edge[grades] - score)
        upper[grades == cut], lower[grades == 0] = 1, 0
        chance = np.maximum(upper - lower, 1e-9)
        d_upper, d_lower = each * upper * (1 - upper) / chance, each * lower * (1 - lower) / chance
        d_score = d_upper - d_lower  # of the negative log-likelihood
        d_edge = np.bincount(grades, -d_upper, n_grades)[:cut] + np.bincount(grades, d_lower, n_grades)[1:]
        tail = np.cumsum(d_edge[::-1])[::-1]
        g = np.concatenate([np.bincount(column, d_score[row] * value, len(chosen)) + penalty * w, tail[:1], tail[1:] * gaps + penalty * p[len(chosen) + 1:]])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        p = p - 0.05 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(buckets, np.float32)
    weights[chosen] = p[:len(chosen)]
    return Ordinal(weights, p[len(chosen)] + np.concatenate([[0], np.cumsum(np.exp(p[len(chosen) + 1:]))]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Ordinal:
    """The model of a bounded sample of labelled documents. labels: doc_id, toxic, quality."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality")
    )
    grade = F.when(F.col("toxic") <= 0, 0).when(F.col("quality") > 0, 1).otherwise(2)
    sample = [
        known.filter(condition).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id", grade.alias("grade"))
        for condition in ("toxic <= 0", "toxic > 0")
    ]
    # at most 2 * per_class rows
    rows = text_of(docs, id_col, text_col).join(F.broadcast(sample[0].union(sample[1])), "doc_id").select("doc_id", "grade", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_features(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *(pa.array([x.astype("<i4").tobytes() for x in side], pa.binary()) for side in zip(*found))] if found
                else [b.column(0), b.column(1), pa.array([], pa.binary()), pa.array([], pa.binary())],
                ["doc_id", "grade", "features", "counts"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(features, f"doc_id {kind}, grade int, features binary, counts binary").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    parsed = [(np.frombuffer(r.features, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i4")) for r in got]
    return fit_ordinal(parsed, np.array([r.grade for r in got], np.int64)) if got else fit_ordinal([], np.zeros(0, np.int64))


class Scorer:
    """Scores of texts; the features of words seen before come from a table of bounded size."""

    def __init__(self, model: Ordinal):
        self.model, self.table = model, {}

    def __call__(self, text: str) -> float:
        words, table, weights = set(text.lower().split()), self.table, self.model.weights
        if len(table) > CACHE_WORDS:
            table.clear()
        counts: dict[int, int] = {}
        for w in words:
            found = table.get(w)
            if found is None:
                found = table[w] = tuple(f for f in word_features(w) if weights[f])
            for f in found:
                counts[f] = counts.get(f, 0) + 1
        return float(sum(weights[f] * (1 + math.log(c)) for f, c in counts.items()))


def grade(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """(doc_id, score, p_toxic, expected_severity, severity, toxic) for every row."""
    rows = text_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = np.array([scorer(t) for t in b.column(1).to_pylist()], float)
            p = model.probabilities(scores)
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *map(pa.array, (scores, toxic, p @ np.arange(p.shape[1]), p.argmax(axis=1).astype(np.int32), toxic > reject))],
                ["doc_id", "score", "p_toxic", "expected_severity", "severity", "toxic"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, p_toxic double, expected_severity double, severity int, toxic boolean")


def keep_clean(docs: DataFrame, model: Ordinal, text_col: str = "text", reject: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is not rejected."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            scores = np.array([scorer(t or "") for t in b.column(at).to_pylist()], float)
            yield b.filter(pa.array(1 - model.probabilities(scores)[:, 0] <= reject))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return grade(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
