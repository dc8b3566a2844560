"""Mixing: held-out accuracy of the classifier, the fit against NumPy, targets, and the edge cases of the docstring."""

import numpy as np
import pytest

from fluxwarden.llm import mixing

SF = "/root/testdata/sf0.01"


def totals(rows, domains):
    return np.array([sum(r.rate * r.tokens * dict(map(tuple, r.posterior))[d] for r in rows) for d in domains])


def test_query_meets_targets(spark):
    rows = mixing.query(spark, SF).collect()
    docs = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.rate >= 0 for r in rows)
    assert all(r.tokens == len(docs[r.doc_id][1].encode().split()) for r in rows)
    reached = totals(rows, list(mixing.WEIGHTS))
    assert np.allclose(reached / reached.sum(), list(mixing.WEIGHTS.values()), atol=1e-3)
    held = [(max(r.posterior, key=lambda x: x.p).domain, docs[r.doc_id][0]) for r in rows if r.tokens > 20]
    assert np.mean([a == b for a, b in held]) > 0.95


@pytest.mark.parametrize("floor", [0.0, 0.4, 1.0])
def test_fit_is_least_squares(spark, floor):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.5, 0.3, 0.2], 400)
    t = rng.integers(0, 500, 400)
    table = spark.createDataFrame([(k, int(t[k]), p[k].tolist()) for k in range(400)], "doc_id bigint, tokens bigint, posterior array<double>")
    weights = {"a": 0.2, "b": 0.2, "c": 0.6}
    moves, target, reached = mixing.fit(table, list("abc"), weights, floor, max_steps=25, tolerance=1e-8)
    r = mixing.rates(p, t, moves, floor)
    assert r.min() >= floor and np.allclose((r * t) @ p, reached)
    inverse = np.linalg.inv((p * t[:, None]).T @ p)  # plain projected gradient from the same start
    plain = np.ones(400)
    residual = [(plain * t) @ p - target]
    for _ in moves:
        plain = np.maximum(floor, plain - p @ (inverse @ residual[-1]))
        residual.append((plain * t) @ p - target)
    norms = [x @ inverse @ x for x in residual]
    plain = np.where(t > 0, plain, max(1.0, floor))
    assert np.allclose(plain, r, atol=1e-6) and all(b <= a + 1e-12 for a, b in zip(norms, norms[1:]))
    if not floor:
        assert norms[-1] < 1e-3 * norms[0]
    if floor == 1.0:
        assert (target >= t @ p - 1e-6).all()


def test_mix_repeats_whole_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labelled = mixing.labelled_languages(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = mixing.mix(docs, labelled)
    assert got.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert set(counts) == {r.doc_id for r in docs.select("doc_id").collect()}
    tokens = {r.lang: r.n for r in got.selectExpr("lang", "size(split(text, ' ')) as n").groupBy("lang").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert max(tokens.values()) / min(tokens.values()) < 1.3


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (None, "", 1.0), (2, "the und " * 70_000, 2.0), (2, "the und", 3.0), (3, "the", 4.0)], "doc_id bigint, text string, rate double")
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    some = spark.createDataFrame([(3, "en"), (2, "de"), (2, "de"), (None, "x"), (1, None)], "doc_id bigint, domain string")
    for labelled in (none, some):
        rows = mixing.fit_rates(docs, labelled, {"en": 0.5, "zz": 0.5}).collect()
        assert sorted(r.tokens for r in rows) == [0, 0, 1, 2, 140_000]
        assert all(0 <= r.rate <= mixing.CEILING and (r.tokens or r.rate == 1) for r in rows)
        mixed = [r.rate for r in mixing.mix(docs, labelled).collect()]
        assert set(mixed) == {0.0, 1.0, 2.0, 3.0, 4.0} and mixed.count(0.0) == mixed.count(1.0) == 1
        assert mixing.fit_rates(docs.limit(0), labelled).count() == 0
