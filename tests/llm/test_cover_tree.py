"""The cover-tree join against all pairs, and the edge cases of the docstring."""

import numpy as np
import pytest

from fluxwarden.llm import cover_tree

SF = "/root/testdata/sf0.01"


def plain(rows, cosine=0.95):
    """vec_id -> (n_links, component, kept) by comparing all pairs."""
    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v, float) / np.linalg.norm(np.array(v, float))) for i, v in rows if fine(v)]
    near = {i: [j for j, y in good if j != i and len(x) == len(y) and x @ y >= cosine] for i, x in good}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, [])), min(seen), min(seen) == i)
    return out


def as_dict(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_query_is_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert as_dict(cover_tree.query(spark, SF)) == plain(rows)


@pytest.mark.parametrize("block_rows", [40, 300])
def test_clusters_over_many_blocks(spark, block_rows):
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(12, 8))
    rows = [(k, [float(x) for x in heads[k % 12 if k % 3 else 0] + rng.normal(size=8) * rng.choice([0.0, 0.1, 0.4])]) for k in range(600)]
    done = cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block_rows=block_rows)
    assert as_dict(done) == plain(rows)


def test_pruning_and_forest():
    rng = np.random.default_rng(1)
    heads = cover_tree.unit(rng.normal(size=(6, 16)))
    x = cover_tree.unit(np.repeat(heads, 50, axis=0) + rng.normal(size=(300, 16)) * 0.01)
    tree = cover_tree.Tree(x, 6)
    leaf = cover_tree.distances(x, tree.centres).argmin(axis=1)
    radii = np.full((tree.chain.shape[1], len(tree.centres)), -1.0)
    for v, k in zip(x, leaf):
        for level, node in enumerate(tree.chain[k]):
            radii[level, node] = max(radii[level, node], cover_tree.distances(v[None], tree.centres[node][None])[0, 0])
    a, b = tree.leaf_pairs(radii, 0.1)
    assert (a == b).all() and len(a) == len(set(leaf))
    assert len(cover_tree.forest(x @ x.T > 0.9)) == 300 - 6


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, "a"), (2, [], "b"), (3, [0.0, 0.0], "c"), (4, [1.0, None], "d"), (5, [nan, 1.0], "e"), (6, [inf, 1.0], "f"),
            (7, [1.0, 0.0], "g"), (8, [2.0, 0.0], "h"), (9, [2.0, 0.0], "i"), (10, [1.0], "j"), (11, [-1.0, 0.0], "k"), (12, [3e38, 0.1], "l")]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rep string")
    assert as_dict(cover_tree.near_vectors(frame)) == plain([r[:2] for r in rows])
    assert as_dict(cover_tree.near_vectors(frame.filter("vec_id < 5"))) == {i: (0, i, True) for i in range(1, 5)}
    assert cover_tree.near_vectors(frame.filter("vec_id > 99")).count() == 0
    repeated = cover_tree.near_vectors(frame.filter("vec_id = 9").union(frame.filter("vec_id = 9"))).collect()
    assert [tuple(r) for r in repeated] == [(9, 1, 9, True)] * 2


def test_one_id_with_several_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (3, [1.0, 0.01]), (4, [0.0, -1.0])]
    done = cover_tree.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in done) == [(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 0, 4, True)]
