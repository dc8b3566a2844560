"""Hard negatives against all pairs, the curve and the bounds by themselves, and the edge cases of the docstring."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxwarden.llm import hard_negatives as hn

SF = "/root/testdata/sf0.01"


def plain(rows, is_anchor, positives=5, negatives=5):
    """Sorted result rows by comparing every anchor with every row."""
    def fine(v):
        return v and all(x is not None and math.isfinite(x) for x in v)

    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and fine(v)]
    out = []
    for n, (a, label, v) in enumerate(good):
        if not is_anchor(a):
            continue
        scored = sorted(
            (-max(hn.LONG[0], min(hn.LONG[1], sum(x * y for x, y in zip(v, w)))), i, lab) for m, (i, lab, w) in enumerate(good) if m != n and len(w) == len(v)
        )
        for p, pos, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:negatives]
            out += [(a, pos, k + 1, neg, -p, -s) for k, (s, neg, _) in enumerate(fits)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_is_brute_force(spark):
    rows = [(r.vec_id, list(r.embedding), (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label)
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    found = result(hn.query(spark, SF))
    assert found and found == plain(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_many_small_blocks(spark, monkeypatch, spread):
    for name, size in (("BLOCK_ROWS", 16), ("CHUNK_ROWS", 8), ("ZONE_ROWS", 4)):
        monkeypatch.setattr(hn, name, size)
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(9, 6))
    rows = [(k, [float(x) for x in heads[k % 9 if k % 3 else 0] + rng.normal(size=6) * spread * (k % 4)], int(rng.integers(3))) for k in range(500)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = result(hn.hard_negatives(frame, F.col("vec_id") % 10 == 0))
    assert found and found == plain(rows, lambda i: i % 10 == 0)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.9, 0.5], 2), (3, None, 1), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
        (7, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (8, [], 1), (9, [1.0], 1), (10, [1.0], 2), (100, [0.99], 1), (11, [-1.0, -0.5], 1),
        (12, [0.9, 0.5], 2), (13, [0.9, 0.5], 3), (200, [-1.0, 0.0], 5), (201, [1.0, 0.0], 5), (202, [0.0, 0.0], 5), (203, [0.0, -1.0], 6),
        (300, [3e30, 0.0], 7), (301, [2e30, 0.0], 7), (302, [1.9e30, 1.0], 8),
    ]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, rid string, pack int")
    found = result(hn.hard_negatives(frame, F.col("vec_id") % 100 == 0))
    assert found == plain(rows, lambda i: i % 100 == 0)
    assert hn.hard_negatives(frame.filter("vec_id > 999"), F.col("vec_id") % 100 == 0).count() == 0
    one = frame.filter("vec_id in (0, 1, 2)")
    twice = result(hn.hard_negatives(one.union(one), F.col("vec_id") % 100 == 0))
    assert twice == plain([r for r in rows if r[0] in (0, 1, 2)] * 2, lambda i: i % 100 == 0)


def test_curve_visits_neighbours():
    side, dims = 4, 3
    cells = np.array(list(np.ndindex(*(side,) * dims)), np.uint8)
    order = np.array(sorted(range(len(cells)), key=lambda i: hn.hilbert_keys(cells[i:i + 1], 2)[0]))
    steps = np.abs(np.diff(cells[order].astype(int), axis=0)).sum(axis=1)
    assert (steps == 1).all()
    assert len(set(hn.hilbert_keys(cells, 2))) == side**dims


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(200, 8)) * 256)
    low, high = rows.min(axis=0)[None], rows.max(axis=0)[None]
    anchors = np.floor(rng.normal(size=(20, 8)) * 256)
    least, most = hn.bounds(anchors, low, high)
    scores = anchors @ rows.T
    assert (least <= scores.min(axis=1)[:, None]).all() and (most >= scores.max(axis=1)[:, None]).all()
    tight = hn.bounds(anchors, rows[:1], rows[:1])
    assert np.allclose(tight[0][:, 0], scores[:, 0]) and np.allclose(tight[1][:, 0], scores[:, 0])
    assert hn.inner(np.array([[2.0**60, 1.0]]), np.array([[2.0**60, 3.0]])).tolist() == [[hn.LONG[1]]]
    assert hn.inner(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0]])).tolist() == [[2**60 + 3]]
