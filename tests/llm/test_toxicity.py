"""Held-out accuracy of the toxicity grades, the ordinal model itself, and the edge cases of the docstring."""

import numpy as np

from fluxwarden.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = toxicity.grade(docs, toxicity.train(docs, seen)).join(held.select("doc_id", F_toxic()), "doc_id").collect()
    truth, said = np.array([r.label for r in rows]) == 1, np.array([r.toxic for r in rows])
    assert (said & truth).sum() / truth.sum() > 0.75
    assert (said & ~truth).sum() / (~truth).sum() < 0.01


def F_toxic():
    from pyspark.sql import functions as F

    return F.col("toxic").alias("label")


def test_query_returns_all_rows(spark):
    rows = toxicity.query(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    assert all(0 <= r.expected_severity <= 2 and r.toxic == (r.p_toxic > 0.5) for r in rows)


def test_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        level = int(rng.integers(0, 3))
        words = np.unique(np.concatenate([rng.integers(0, 50, 8), np.array([100 + level])]))
        rows.append((words, np.ones(len(words), int)))
        grades.append(level)
    model = toxicity.fit_ordinal(rows, np.array(grades), buckets=200)
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[100] < model.weights[101] < model.weights[102]
    scores = np.array([model.weights[f] @ (1 + np.log(c)) for f, c in rows])
    assert (model.probabilities(scores).argmax(axis=1) == grades).mean() > 0.75
    assert np.allclose(model.probabilities(scores).sum(axis=1), 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (None, "", 1.0), (2, "bad word " * 70_000, 2.0), (2, "bad word", 3.0)], "doc_id bigint, text string, score double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(2, 1, 1), (2, 0, 0), (None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")):
        model = toxicity.train(docs, labels)
        assert [r.toxic for r in toxicity.grade(docs, model).collect()] == [False] * 4
        assert toxicity.keep_clean(docs, model).count() == 4
    model = toxicity.train(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id bigint, quality int, toxic int"))
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    assert toxicity.grade(docs.limit(0), model).count() == 0
