"""Exact near-duplicate embeddings by a dual traversal of a cover tree.

Vectors are scaled to length one; cosine >= c is chord distance <= sqrt(2 - 2c). The upper tree is a cover tree over
a bounded sample: nested levels of centres whose radii halve (2, 1, 1/2, ...), every new centre of a level farther
than its radius from all others, its parent the nearest centre one level up. Every vector is then filed under its
nearest lowest centre, and a node's covering radius is the largest distance of any vector below it, over all
vectors. The sample only shapes the tree; results do not depend on it.

The traversal starts with the root and descends pairs of nodes level by level. A pair with
``d(centre, centre) > radius + radius + t`` holds no pair of near vectors and is dropped. Pairs of leaves that remain
are compared in blocks, each vector only with leaves where ``d(vector, centre) <= radius + t``, in double precision.
For vectors without any cluster structure no metric tree can prune in high dimension, and the traversal visits all
pairs of blocks; the work is then quadratic, spread over blocks, and still exact.

Equal vectors are one vector with a count. A block pair returns link counts by vector and a spanning forest of its
links, never its pairs, so a dense group of any size gives as many rows as it has members in the block pair.
Leaves are cut into blocks of ``block_rows``: a hot leaf is many tasks.

Defined results: a null, empty or zero vector and one with null or non-finite components links with nothing and
is its own component; vectors of different length do not link; repeated rows of a vector id count as other
vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, connected_components, partitions

SAMPLE_ROWS = 4096
MAX_LEAVES = 1024
BLOCK_ROWS = 2048


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.forall(vector, number) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    rows = np.asarray(rows, np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ centres.T)))


class Tree:
    """Nested levels of centres. ``chain[k]`` has the centre above leaf k at every level, root first."""

    def __init__(self, sample: np.ndarray, leaves: int):
        picked, self.levels, radius = [0], [1], 1.0
        parents: list[dict[int, int]] = [{0: 0}]
        gap = distances(sample, sample[:1])[:, 0]
        while len(picked) < min(leaves, len(sample)) and gap.max() > 1e-6:
            above, parent = len(picked), {k: k for k in range(len(picked))}
            centres = sample[picked]
            while len(picked) < leaves:
                far = np.flatnonzero(gap > radius)
                if not len(far):
                    break
                new = int(far[0])
                parent[len(picked)] = int(distances(sample[new:new + 1], centres[:above])[0].argmin())
                picked.append(new)
                gap = np.minimum(gap, distances(sample, sample[new:new + 1])[:, 0])
            parents.append(parent)
            self.levels.append(len(picked))
            radius /= 2
        self.centres = sample[picked]
        chain = [list(range(len(picked)))]
        for parent in reversed(parents[1:]):
            chain.append([parent[k] for k in chain[-1]])
        self.chain = np.array(chain[::-1] if len(parents) > 1 else chain[:1], np.int64).T

    def leaf_pairs(self, radii: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves that may hold near vectors. radii[level, centre]: covering radius, -1 where empty."""
        a = b = np.zeros(1, np.int64)
        slack = 1e-7
        for level in range(self.chain.shape[1]):
            if level:
                below: dict[int, list[int]] = {}
                for child, parent in sorted(set(zip(self.chain[:, level].tolist(), self.chain[:, level - 1].tolist()))):
                    below.setdefault(parent, []).append(child)
                pairs = {(min(x, y), max(x, y)) for p, q in zip(a.tolist(), b.tolist()) for x in below[p] for y in below[q]}
                a, b = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (a[:0], b[:0])
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.centres[a], self.centres[b])))
            ra, rb = radii[level, a], radii[level, b]
            keep = (ra >= 0) & (rb >= 0) & (apart <= ra + rb + t + slack)
            a, b = a[keep], b[keep]
        return a, b


def matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, all lists of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix; a node reached is not visited again."""
    left, links = near.any(axis=1), []
    while left.any():
        frontier = [int(left.argmax())]
        left[frontier[0]] = False
        while frontier:
            x = frontier.pop()
            hits = np.flatnonzero(near[x] & left)
            left[hits] = False
            links += [(x, int(h)) for h in hits]
            frontier += hits.tolist()
    return links


def compare(counts, x, side, cosine, same: bool):
    """Link counts of the rows of a block pair, and a spanning forest of its links. side: 0 or 1 by row."""
    degree = np.zeros(len(x), np.int64)
    one, two = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    found = []
    for at in range(0, len(one), 512):
        near = x[one[at:at + 512]] @ x[two].T >= cosine
        if near.any():
            i, j = np.nonzero(near)
            found.append(np.stack([one[at + i], two[j]]))
    if not found:
        return degree, []
    i, j = np.concatenate(found, axis=1)
    if same:
        i, j = i[i != j], j[i != j]
    else:
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
    if not len(i):
        return degree, []
    np.add.at(degree, i, counts[j])
    nodes, i = np.unique(i, return_inverse=True)
    near = np.zeros((len(nodes), len(nodes)), bool)
    near[i, np.searchsorted(nodes, j)] = True
    return degree, [(int(nodes[a]), int(nodes[b])) for a, b in forest(near)]


def near_vectors(
    vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS, max_leaves: int = MAX_LEAVES,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    stages = Stages(spark)
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))
    good = rows.filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    # a distinct vector has a number of its own: an id may have several vectors
    vectors = stages.keep(good.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    reps = stages.keep(vectors.withColumn("rep", F.monotonically_increasing_id()))
    sizes = [r[0] for r in reps.groupBy(F.size("v")).count().orderBy("count", ascending=False).collect()]
    parts = [_links(stages, reps.filter(F.size("v") == n).select("v", "rep", "copies"), cosine, block_rows, sample_rows, max_leaves) for n in sizes]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    component = connected_components(found.filter("b is not null").select("a", "b"))
    named = reps.join(component, F.col("rep") == F.col("id")).groupBy("component").agg(F.min("least").alias("name"))
    known = reps.join(counts, "rep", "left").join(component.join(named, "component"), F.col("rep") == F.col("id"), "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("name", "least").alias("component_id"),
    )
    return rows.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(stages: Stages, reps: DataFrame, cosine: float, block_rows: int, sample_rows: int, max_leaves: int) -> DataFrame:
    """(a, b, n): link counts of vector a where b is null, else a link. All vectors have one length."""
    spark = reps.sparkSession
    t = float(np.sqrt(2 - 2 * cosine))
    total = reps.count()
    sample = reps.orderBy(F.xxhash64("v"), "rep").limit(sample_rows).select("v").collect()
    tree = Tree(unit(np.array([r[0] for r in sample])), max(1, min(max_leaves, -(-total // block_rows))))
    centres, chain = tree.centres, tree.chain

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The leaf of each vector, and its distance to the node above it at each level."""
        for b in batches:
            if not len(b):
                continue
            d = distances(unit(matrix(b.column(0))), centres)
            leaf = d.argmin(axis=1)
            far = np.take_along_axis(d, chain[leaf], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(leaf), pa.array(list(far), pa.list_(pa.float64()))],
                ["v", "rep", "copies", "leaf", "far"],
            )

    kind, id_kind = reps.schema["v"].dataType.simpleString(), reps.schema["rep"].dataType.simpleString()
    shape = f"v {kind}, rep {id_kind}, copies bigint, leaf bigint"
    filed = stages.keep(reps.select("v", "rep", "copies").mapInArrow(file, shape + ", far array<double>"))
    leaves = filed.groupBy("leaf").agg(F.count("*"), *[F.max(F.get("far", F.lit(k))) for k in range(chain.shape[1])])
    radii, blocks = np.full((chain.shape[1], len(centres)), -1.0), np.zeros(len(centres), np.int64)
    for leaf, count, *far in leaves.collect():  # a row for each leaf
        blocks[leaf] = -(-count // block_rows)
        for level, r in enumerate(far):
            node = chain[leaf, level]
            radii[level, node] = max(radii[level, node], r)
    a, b = tree.leaf_pairs(radii, t)
    partners: dict[int, list[int]] = {}
    for x, y in zip(a.tolist(), b.tolist()):
        partners.setdefault(x, []).append(y)
        if x != y:
            partners.setdefault(y, []).append(x)
    last, first = radii[-1], np.concatenate([[0], np.cumsum(blocks)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every vector once for each pair of blocks in which it may have a near vector."""
        for batch in batches:
            if not len(batch):
                continue
            leaf, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 1))
            own = first[leaf] + (rep.astype(np.int64) * 2654435761 >> 7) % blocks[leaf]
            d = distances(unit(matrix(batch.column(0))), centres)
            for k in np.unique(leaf):
                for other in partners.get(int(k), []):
                    take = np.flatnonzero((leaf == k) & (d[:, other] <= last[other] + t + 1e-7))
                    if not len(take):
                        continue
                    for block in range(first[other], first[other + 1]):
                        lo, hi = np.minimum(own[take], block), np.maximum(own[take], block)
                        yield pa.RecordBatch.from_arrays(
                            [*(batch.column(i).take(pa.array(take)) for i in range(3)), pa.array(lo << 32 | hi), pa.array((own[take] != lo).astype(np.int32))],
                            ["v", "rep", "copies", "pair", "side"],
                        )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, counts, pair, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            degree, links = compare(counts, unit(matrix(b.column(0))), side, cosine, int(pair[0]) >> 32 == int(pair[0]) & 0xFFFFFFFF)
            has = np.flatnonzero(degree)
            links = np.array(links, np.int64).reshape(-1, 2)
            kind = b.schema.field("rep").type
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[has], ids[links[:, 0]]]), kind),
                    pa.concat_arrays([pa.nulls(len(has), kind), pa.array(ids[links[:, 1]], kind)]),
                    pa.array(np.concatenate([degree[has], np.zeros(len(links), np.int64)])),
                ],
                ["a", "b", "n"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            pair = batch.column(3).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if held and held[-1].column(3)[0].as_py() != int(pair[lo]):
                    yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield emit(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    dealt = filed.drop("far").mapInArrow(deal, f"v {kind}, rep {id_kind}, copies bigint, pair bigint, side int")
    grouped = dealt.repartition(partitions(spark), "pair").sortWithinPartitions("pair")
    return stages.keep(grouped.mapInArrow(check, f"a {id_kind}, b {id_kind}, n bigint"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
