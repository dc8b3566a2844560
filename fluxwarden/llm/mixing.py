"""Mixing documents to target domain weights with soft membership.

A classifier fitted on labelled documents gives every document a posterior over domains. Rates r >= ``floor`` (0, or
any lower bound) are then fitted so that the expected tokens of each domain, sum of rate * tokens * posterior, meet
their targets in the least-squares sense, starting from rate 1.

Classifier: multinomial naive Bayes over hashed words; the counts come from at most ``sample_docs`` labelled
documents (smallest hashes of their ids). The evidence of a text counts as that of at most ``EVIDENCE`` words, so
posteriors stay soft and a text of two languages belongs to both.

Fit: with a_d = tokens_d * posterior_d and M = sum of tokens_d * posterior_d posterior_d', a step is
``r_d <- clip(r_d - posterior_d . M^-1 (sum r a - target), floor, ceiling)``. This is the projected gradient of the least-squares
residual in the norm of M^-1, scaled by 1 / tokens_d, whose step length 1 is the inverse of its Lipschitz constant.
Rates end at ``CEILING``: a domain whose documents cannot meet its target stays below it. A step needs one sum per
domain from each task; the driver sees a vector of as many numbers as there are domains.
A document's rate follows from the residuals of all steps, so no state is kept but a compact table of
(doc_id, tokens, posterior) in the shared folder.

Defined results: a null text is the empty text with no tokens, the prior as posterior and rate ``max(floor, 1)``; null ids and repeated rows are kept, each with its rate; without labelled documents there
is one domain ``all``; target domains that no document is labelled with are ignored, and the weights of the others
scaled to one; an empty table gives an empty result; extra columns are ignored by ``fit_rates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, text_of

BUCKETS = 1 << 16
SAMPLE_DOCS = 20_000
EVIDENCE = 32
CEILING = 1000.0
COPIES = 10_000
MAX_STEPS = 25
CACHE_WORDS = 400_000


class Words:
    """Hashed words of texts; hashes of words seen before come from a table of bounded size."""

    def __init__(self) -> None:
        self.table: dict[bytes, int] = {}

    def __call__(self, data: bytes) -> np.ndarray:
        words, table = data.lower().split(), self.table
        if len(table) > CACHE_WORDS:
            table.clear()
        for w in set(words):
            if w not in table:
                table[w] = xxhash.xxh32_intdigest(w.strip(b".,;:!?"), 0) % BUCKETS
        return np.fromiter(map(table.__getitem__, words), np.int64, len(words))


@dataclass
class Classifier:
    domains: list[str]
    prior: np.ndarray
    log_word: np.ndarray  # (bucket, domain)

    def posterior(self, words: np.ndarray) -> np.ndarray:
        log = np.log(self.prior)
        if len(words):
            log = log + self.log_word[words].mean(axis=0) * min(len(words), EVIDENCE)
        p = np.exp(log - log.max())
        return p / p.sum()


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """labelled: (doc_id, domain). Word counts per domain are summed by Spark: a row for each domain and bucket."""
    known = labelled.dropna().groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = text_of(docs, id_col, text_col).join(F.broadcast(sample), "doc_id").select("domain", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = Words(), {}
        for b in batches:
            for domain, text in zip(b.column(0).to_pylist(), b.column(1)):
                total = totals.setdefault(domain, np.zeros(BUCKETS + 1, np.int64))
                total[:BUCKETS] += np.bincount(words(text.as_py()), minlength=BUCKETS)
                total[BUCKETS] += 1
        for domain, total in totals.items():
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([domain] * len(has), pa.string()), pa.array(has), pa.array(total[has])], ["domain", "bucket", "n"])

    got = rows.withColumn("domain", F.col("domain").cast("string")).mapInArrow(count, "domain string, bucket bigint, n bigint").groupBy("domain", "bucket").agg(F.sum("n").alias("n")).collect()
    domains = sorted({r.domain for r in got}) or ["all"]
    table = np.zeros((BUCKETS + 1, len(domains)))
    for r in got:
        table[r.bucket, domains.index(r.domain)] = r.n
    counts, n_docs = table[:BUCKETS] + 0.1, table[BUCKETS] + 1
    return Classifier(domains, n_docs / n_docs.sum(), np.log(counts / counts.sum(axis=0)).astype(np.float32))


def memberships(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, posterior) for every row, computed where the rows lie. Tokens are words."""
    rows = text_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            found = [words(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in found], pa.int64()), pa.array([classifier.posterior(w) for w in found], pa.list_(pa.float64()))],
                ["doc_id", "tokens", "posterior"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, tokens bigint, posterior array<double>")


def rates(posterior: np.ndarray, tokens: np.ndarray, moves: list[np.ndarray], floor: float, ceiling: float = CEILING) -> np.ndarray:
    """The rates after the given steps, by document; a document without tokens stays where it starts."""
    start = np.full(len(posterior), max(1.0, floor))
    r = start
    for move in moves:
        r = np.clip(r - posterior @ move, floor, max(ceiling, floor))
    return np.where(np.asarray(tokens) > 0, r, start)


def _matrix(b: pa.RecordBatch, k: int) -> np.ndarray:
    return b.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(table: DataFrame, k: int, row_sums) -> np.ndarray:
    """The sum over all rows of row_sums(tokens, posterior), a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if len(b):
                total = total + row_sums(b.column("tokens").to_numpy(zero_copy_only=False).astype(float), _matrix(b, k))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "x"])

    got = table.select("tokens", "posterior").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()
    return np.array([r.x for r in sorted(got, key=lambda r: r.k)])


def fit(table: DataFrame, domains: list[str], weights: dict[str, float] | None, floor: float, max_steps: int = MAX_STEPS, tolerance: float = 1e-6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Steps, targets and the reached totals. With a floor of one or more no document is given up: the targets are
    then scaled to the smallest total at which every domain's target is at least what it has at the floor."""
    k = len(domains)
    got = _sums(table, k, lambda t, p: np.concatenate([t @ p, ((p * t[:, None]).T @ p).ravel()]))
    if not len(got):
        return [], np.zeros(k), np.zeros(k)
    base, m = got[:k], got[k:].reshape(k, k)
    share = np.array([(weights or {}).get(d, 0.0) for d in domains]) if weights else np.ones(k)
    share = share / share.sum() if share.sum() > 0 else np.ones(k) / k
    target = share * base.sum()
    if floor >= 1:
        scale = max((floor * b / s for b, s in zip(base, share) if s > 0), default=base.sum())
        target = share * max(scale, base.sum())
    inverse = np.linalg.pinv(m + np.eye(k) * 1e-9 * max(m.trace(), 1e-9), hermitian=True)
    moves: list[np.ndarray] = []
    reached = base * max(1.0, floor)
    for _ in range(max_steps):
        if np.abs(reached - target).sum() <= tolerance * max(target.sum(), 1e-9):
            break
        moves.append(inverse @ (reached - target))
        before, so_far = reached, list(moves)
        reached = _sums(table, k, lambda t, p: (rates(p, t, so_far, floor) * t) @ p)
        if np.abs(reached - before).sum() <= tolerance * 0.1 * max(target.sum(), 1e-9):
            break
    return moves, target, reached


def fit_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", floor: float = 0.0, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, tokens, posterior, rate) for every row. posterior: (domain, p) pairs. weights: by domain, else equal."""
    classifier = train(docs, labelled, id_col, text_col, sample_docs)
    table = Stages(docs.sparkSession).keep(memberships(docs, classifier, id_col, text_col))
    moves, _, _ = fit(table, classifier.domains, weights, floor)
    k, kind = len(classifier.domains), table.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rates(_matrix(b, k), b.column("tokens").to_numpy(zero_copy_only=False), moves, floor))], [*b.schema.names, "rate"])

    names = F.array(*[F.lit(d) for d in classifier.domains])
    return table.mapInArrow(run, f"doc_id {kind}, tokens bigint, posterior array<double>, rate double").select(
        "doc_id", "tokens", F.zip_with(names, "posterior", lambda d, p: F.struct(d.alias("domain"), p.alias("p"))).alias("posterior"), "rate"
    )


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", floor: float = 1.0, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says: the whole part, and once more where a hash
    of id and text falls below the rest. With the default floor every row stays. Posterior and rate are computed
    again where the rows lie, which costs a pass over the text and saves a shuffle of it."""
    classifier = train(docs, labelled, id_col, text_col, sample_docs)
    table = Stages(docs.sparkSession).keep(memberships(docs, classifier, id_col, text_col))
    moves, _, _ = fit(table, classifier.domains, weights, floor)
    at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            if not len(b):
                continue
            data = [(t or "").encode() for t in b.column(at).to_pylist()]
            found = [words(t) for t in data]
            r = rates(np.array([classifier.posterior(w) for w in found]), np.array([len(w) for w in found]), moves, floor)
            ids = b.column(id_at).to_pylist()
            u = np.array([xxhash.xxh64_intdigest(f"{i}:".encode() + t, 7) / 2**64 for i, t in zip(ids, data)])
            copies = np.floor(r).astype(np.int64) + (u < r - np.floor(r))
            ends = np.cumsum(copies)
            for first in range(0, int(ends[-1]), COPIES):  # no batch of all copies of a row
                yield b.take(pa.array(np.searchsorted(ends, np.arange(first, min(first + COPIES, int(ends[-1]))), side="right")))

    return docs.mapInArrow(run, docs.schema)


#: Targets of the query: the share of each language in the mix.
WEIGHTS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, domain): the language of the documents that the labels table covers."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labels.select("doc_id"), "doc_id", "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return fit_rates(docs, labelled_languages(docs, labels), WEIGHTS)
