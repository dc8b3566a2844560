"""The model against plain Python, held-out quality labels, and the edge cases of the docstring."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxwarden.llm import kneser_ney
from fluxwarden.llm.common import Stages


def plain_model(texts):
    """p(last | first three) by the textbook formulas over strings."""
    pad = chr(2) * 3
    levels = {4: Counter(t[i:i + 4] for t in (pad + x for x in texts) for i in range(len(t) - 3))}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    symbols = len(levels[1]) + 1

    def parts(k):
        n = Counter(levels[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {j: min(max(j - (j + 1) * y * n[j + 1] / n[j], 0.0), float(j)) if n[j] and n[1] else 0.5 for j in (1, 2, 3)}
        total, left = defaultdict(int), defaultdict(float)
        for g, c in levels[k].items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        return d, total, left

    made = {k: parts(k) for k in levels}

    def p(g):
        if not g:
            return 1 / symbols
        d, total, left = made[len(g)]
        if g[:-1] not in total:
            return p(g[1:])
        c = levels[len(g)][g]
        return ((c - d[min(c, 3)]) if c else 0) / total[g[:-1]] + left[g[:-1]] / total[g[:-1]] * p(g[1:])

    return p


@pytest.mark.parametrize("block_bytes", [200, 1 << 26])
def test_model_and_scores(spark, block_bytes):
    good = ["the cat sat on the mat", "a dog sat on the log", "the end", "cats and dogs"] * 3 + ["übel"]
    rows = [(k, "en", t) for k, t in enumerate(good)] + [(100, "en", "zzz qq the"), (101, "xx", "the cat"), (102, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    trusted = spark.createDataFrame([(k,) for k in range(len(good))], "doc_id bigint")
    p = plain_model(good)
    got = {r.doc_id: r for r in kneser_ney.quality(docs, trusted, block_bytes=block_bytes).collect()}
    for i, lang, text in rows:
        t = chr(2) * 3 + text
        if lang == "en" and text:
            nll = -sum(math.log(p(t[k:k + 4])) for k in range(len(text)))
            assert got[i].perplexity == pytest.approx(math.exp(nll / len(text)), rel=1e-9), text
    assert not got[100].kept and got[101].kept and got[101].threshold is None
    assert got[102].perplexity is None and not got[102].kept
    counts = kneser_ney._count(docs.crossJoin(spark.range(1).selectExpr("true as trusted")))
    table = kneser_ney.gram_probabilities(Stages(spark), counts.filter("lang = 'xx'"))
    assert table.selectExpr("max(logp) <= 0 as fine").first().fine


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = kneser_ney.quality(docs, labels.filter("quality = 1 and toxic = 0 and doc_id % 2 = 0"))
    held = rows.join(labels.filter("doc_id % 2 = 1 and toxic = 0"), "doc_id").collect()
    kept, good = np.array([r.kept for r in held]), np.array([r.quality for r in held]) == 1
    assert kept[good].mean() > 0.97
    assert kept[~good].mean() < 0.15


def test_edges(spark):
    rows = [(None, None, None, 1), (1, "en", None, 2), (1, "en", "12 34", 3), (1, "en", "12 34", 3), (2, None, "\U0001F600x", 4), (3, "en", "long " * 60_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string, gram int")
    none = spark.createDataFrame([], "doc_id bigint")
    assert kneser_ney.quality(docs, none).count() == 6
    some = spark.createDataFrame([(1,), (None,), (3,), (3,)], "doc_id bigint")
    assert sorted(r.doc_id or 0 for r in kneser_ney.quality(docs, some).collect()) == [0, 1, 1, 1, 2, 3]
    assert kneser_ney.quality(docs.limit(0), some).count() == 0
