"""Hard negatives from blocks along a Hilbert curve, chosen by zone maps.

Rows are scaled to integers, ordered along a Hilbert curve over all dimensions (``HILBERT_BITS`` bits each, widest
dimension first) and written as Parquet blocks of ``BLOCK_ROWS`` rows with the least and greatest value of every
dimension and the labels of the block: its zone map. For an anchor ``a`` and a block with bounds ``lo <= x <= hi`` the
inner product lies, by interval arithmetic, in

    [a+ . lo + a- . hi, a+ . hi + a- . lo],    a+ = max(a, 0), a- = min(a, 0).

A search has windows (least and greatest score, same or other label) for each anchor. It first reads the ``PROBE``
blocks of the highest upper bounds that can hold a score of the window; the fifth best score found there raises the
window's lower end. Then it reads every block whose bounds meet what is left of the window. The second round alone
makes the result, so it is exact whatever the first round found. The first search gives each anchor its positives, the
second looks between 80 % and 100 % of each positive's score.

Anchors are packed into chunks along the same curve; anchors that ask for the same block read it together. Blocks and
chunks meet in joins on (chunk, block); zone maps meet the anchors in blocks of ``ZONE_ROWS`` zones, the same for
each block of anchors. Nothing is broadcast, and no task holds more than a chunk, a block and their scores. Equal
vectors are ordered by id, so a block never depends on the size of a group of copies. Where the data have no cluster
structure the bounds cannot prune, every block is read by every chunk, and the result is still exact.

Scores are exact: in double precision while the largest possible sum is below 2^53, else in Python's integers. A score
beyond the range of a long counts as the end of that range; window ends beyond 2^53 are rounded to doubles.

Defined results: rows with a null id, label or vector, an empty vector, or a component that is null or not finite
(also after scaling) take no part; vectors of different length are never compared; repeated rows of an id are other
rows, each with its own results, ties between them are broken arbitrarily; an anchor without positives, or a window
without negatives, gives no row; a window of a negative score is empty; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fluxwarden.llm.common import Stages, partitions

BLOCK_ROWS = 1024
CHUNK_ROWS = 512
ZONE_ROWS = 1024
PROBE = 4
HILBERT_BITS = 2
SAMPLE_ROWS = 4096
NEGATIVES = 5
POSITIVES = 5
SCALE = 256
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b: whole numbers as doubles, or Python's integers."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if bound < 2.0**53:
        return a @ b.T
    exact = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return np.clip(exact[0] @ exact[1].T, *LONG)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of every anchor with every block, widened by rounding errors."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = (np.abs(a).sum(axis=1)[:, None] * np.maximum(np.abs(low), np.abs(high)).max(axis=1)[None, :]) * 1e-12
        ends = [float(x) for x in LONG]
        return np.clip(np.nan_to_num(least - slack, nan=-np.inf), *ends), np.clip(np.nan_to_num(most + slack, nan=np.inf), *ends)


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places along the Hilbert curve of points with ``bits`` bits in each dimension, as bytes in order.

    Gray-code walk from the highest bit down: at each bit, dimensions are reflected or exchanged with the first one,
    then the transposed index is read off bit by bit."""
    x = cells.astype(np.uint8).copy()
    dims, q = x.shape[1], 1 << (bits - 1)
    while q > 1:
        mask = q - 1
        for d in range(dims):
            on = (x[:, d] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & mask).astype(np.uint8)
            x[:, 0] ^= np.where(on, mask, swap).astype(np.uint8)
            x[:, d] ^= swap
        q >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip, q = np.zeros(len(x), np.uint8), 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[:, -1] & q, q - 1, 0).astype(np.uint8)
        q >>= 1
    x ^= flip[:, None]
    plane = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(plane, axis=1), axis=1)]


def prepared(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dims, key, vec): usable rows, scaled, with their place on the curve."""
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.select("vec_id", "label", F.transform("v", lambda x: x.cast("double")).alias("v"))
    cuts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    sample = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SAMPLE_ROWS).select("v").collect()
    for dims, group in itertools.groupby(sorted((r[0] for r in sample), key=len), len):
        x = np.array(list(group))
        steps = np.arange(1, 1 << HILBERT_BITS) / (1 << HILBERT_BITS)
        with np.errstate(over="ignore", invalid="ignore"):
            spread = np.nan_to_num(x.std(axis=0), posinf=np.inf)
        cuts[dims] = (np.argsort(-spread, kind="stable"), np.quantile(x, steps, axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, vecs, sizes = [], [], []
            for v in b.column(2).to_pylist():
                x = np.array(v)
                order, cut = cuts.get(len(x), (np.arange(len(x)), np.zeros((1, len(x)))))
                sizes.append(len(x))
                keys.append((x[None, :] > cut).sum(axis=0)[order])
                vecs.append(np.floor(x * SCALE).tobytes())
            out: list[bytes] = [b""] * len(keys)
            for dims in set(sizes):
                at = [i for i, n in enumerate(sizes) if n == dims]
                for i, key in zip(at, hilbert_keys(np.array([keys[i] for i in at]), HILBERT_BITS)):
                    out[i] = key
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sizes, pa.int32()), pa.array(out, pa.binary()), pa.array(vecs, pa.binary())],
                ["vec_id", "label", "dims", "key", "vec"],
            )

    return rows.mapInArrow(run, "vec_id bigint, label bigint, dims int, key binary, vec binary")


PACKED = "pack bigint, dims int, rids binary, ids binary, labels binary, vecs binary, lows binary, highs binary"


def packed(rows: DataFrame, size: int, windows: int) -> DataFrame:
    """Rows (rid, vec_id, label, dims, key, vec, lows, highs) in curve order, ``size`` to a pack; inside a pack by id.

    lows, highs: arrays of ``windows`` window ends."""
    count = rows.count()  # of a written table
    n = max(1, min(max(partitions(rows.sparkSession), count // 100_000), -(-count // size)))
    order = ["dims", "key", "vec_id", "rid"]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            rows.sort(key=lambda r: (r[1], r[0]))
            dims = rows[0][3]
            parts = [np.array([r[k] for r in rows], np.int64).tobytes() for k in (0, 1, 2)]
            parts.append(b"".join(r[4] for r in rows))
            parts += [np.array([r[k] for r in rows], np.float64).reshape(len(rows), windows).tobytes() for k in (5, 6)]
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([number - 1]), pa.array([dims], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)],
                ["pack", "dims", "rids", "ids", "labels", "vecs", "lows", "highs"],
            )

        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("rid", "vec_id", "label", "dims", "vec", "lows", "highs"))):
                if held and (len(held) == size or held[0][3] != row[3]):
                    yield emit(held)
                    held = []
                held.append(row)
        if held:
            yield emit(held)

    return dealt.select("rid", "vec_id", "label", "dims", "vec", "lows", "highs").mapInArrow(run, PACKED)


def zones(blocks: DataFrame) -> DataFrame:
    """(part, dims, n, blocks, low, high, labels): the zone maps, ``ZONE_ROWS`` to a row. labels: a list for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, dims, labels, vecs in zip(*(c.to_pylist() for c in b.columns)):
                x = np.frombuffer(vecs, np.float64).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([pack]), pa.array([dims], pa.int32()), pa.array([x.min(axis=0).tobytes()], pa.binary()),
                     pa.array([x.max(axis=0).tobytes()], pa.binary()), pa.array([np.unique(np.frombuffer(labels, np.int64)).tolist()], pa.list_(pa.int64()))],
                    ["pack", "dims", "low", "high", "labels"],
                )

    maps = blocks.select("pack", "dims", "labels", "vecs").mapInArrow(
        run, "pack bigint, dims int, low binary, high binary, labels array<bigint>"
    )
    # packs of one task have consecutive numbers, so the parts are of even size
    return maps.withColumn("part", F.floor(F.col("pack") / ZONE_ROWS)).groupBy("dims", "part").agg(
        F.sort_array(F.collect_list(F.struct("pack", "low", "high", "labels"))).alias("zone")
    )


class Chunk:
    """A pack of anchors with the windows of each."""

    def __init__(self, rids: bytes, ids: bytes, labels: bytes, vecs: bytes, dims: int, lows: bytes = b"", highs: bytes = b""):
        self.rids, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rids, ids, labels))
        self.vecs = np.frombuffer(vecs, np.float64).reshape(-1, dims)
        self.lows, self.highs = (np.frombuffer(x, np.float64).reshape(len(self.ids), -1) for x in (lows, highs))


class Chunk:
    """A pack of anchors with the windows of each."""

    def __init__(self, rids: bytes, ids: bytes, labels: bytes, vecs: bytes, dims: int, lows: bytes = b"", highs: bytes = b""):
        self.rids, self.ids, self.labels = (np.frombuffer(x, np.int64) for x in (rids, ids, labels))
        self.vecs = np.frombuffer(vecs, np.float64).reshape(-1, dims)
        self.lows, self.highs = (np.frombuffer(x, np.float64).reshape(len(self.ids), -1) for x in (lows, highs))


def chosen(chunks: DataFrame, maps: DataFrame, same: bool) -> DataFrame:
    """(chunk, block, anchor, upper): blocks whose bounds meet a window of an anchor and that hold a label it asks for."""
    parts = maps.select(F.col("dims").alias("zone_dims"), "zone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, dims, labels, vecs, lows, highs, zone in zip(*(c.to_pylist() for c in b.columns)):
                blank = np.zeros(len(labels) // 8, np.int64).tobytes()
                c = Chunk(blank, blank, labels, vecs, dims, lows, highs)
                low, high = (np.frombuffer(b"".join(z[k] for z in zone), np.float64).reshape(-1, dims) for k in ("low", "high"))
                least, most = bounds(c.vecs, low, high)
                meet = np.zeros(least.shape, bool)
                for w in range(c.lows.shape[1]):
                    meet |= (most >= c.lows[:, w, None]) & (least <= c.highs[:, w, None])
                kinds = [set(z["labels"]) for z in zone]
                own = {k: np.array([(k in kind) if same else bool(kind - {k}) for kind in kinds]) for k in set(c.labels.tolist())}
                meet &= np.stack([own[k] for k in c.labels.tolist()])
                anchor, at = np.nonzero(meet)
                blocks = np.array([z["pack"] for z in zone], np.int64)[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), pack)), pa.array(blocks), pa.array(anchor.astype(np.int32)), pa.array(most[anchor, at])],
                    ["chunk", "block", "anchor", "upper"],
                )

    met = chunks.join(parts, F.col("dims") == F.col("zone_dims")).select("pack", "dims", "labels", "vecs", "lows", "highs", "zone")
    return met.mapInArrow(run, "chunk bigint, block bigint, anchor int, upper double")


def chosen(chunks: DataFrame, maps: DataFrame, same: bool, best: int | None = None) -> DataFrame:
    """(chunk, block, anchors): the blocks whose bounds meet a window of an anchor and that hold a label it asks for,
    with the anchors that ask. ``best``: for each anchor only so many, those of the highest upper bounds."""
    # numbers only: which rows of zones go with which chunk
    meets = chunks.select("pack", "dims").join(maps.select("dims", "part"), "dims").select("pack", "part", F.col("dims").alias("d"))
    parts = maps.select(F.col("dims").alias("d"), "part", "zone")
    asked = meets.join(parts, ["d", "part"]).select("pack", "zone").join(
        chunks.select("pack", "dims", "labels", "vecs", "lows", "highs"), "pack"
    ).select("pack", "dims", "labels", "vecs", "lows", "highs", "zone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                yield read_list(*row, same, best)

    met = asked.mapInArrow(run, "chunk bigint, block bigint, anchors array<int>, uppers array<double>")
    if best is None:
        return met.select("chunk", "block", "anchors")
    each = met.select("chunk", "block", F.explode(F.arrays_zip("anchors", "uppers")).alias("x")).select("chunk", "block", "x.anchors", "x.uppers")
    order = Window.partitionBy("chunk", "anchors").orderBy(F.desc("uppers"), "block")
    first = each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= best)
    return first.groupBy("chunk", "block").agg(F.sort_array(F.collect_list("anchors")).alias("anchors"))


def read_list(pack: int, dims: int, labels: bytes, vecs: bytes, lows: bytes, highs: bytes, zone: list, same: bool, best: int | None) -> pa.RecordBatch:
    """The reads of one chunk in one row of zone maps."""
    blank = np.zeros(len(labels) // 8, np.int64).tobytes()
    c = Chunk(blank, blank, labels, vecs, dims, lows, highs)
    low, high = (np.frombuffer(b"".join(z[k] for z in zone), np.float64).reshape(-1, dims) for k in ("low", "high"))
    least, most = bounds(c.vecs, low, high)
    meet = np.zeros(least.shape, bool)
    for w in range(c.lows.shape[1]):
        meet |= (most >= c.lows[:, w, None]) & (least <= c.highs[:, w, None])
    kinds = [set(z["labels"]) for z in zone]
    own = {k: np.array([(k in kind) if same else bool(kind - {k}) for kind in kinds]) for k in set(c.labels.tolist())}
    meet &= np.stack([own[k] for k in c.labels.tolist()])
    if best is not None and len(zone) > best:
        ranked = np.argsort(np.where(meet, -most, np.inf), axis=1, kind="stable")[:, :best]
        top = np.zeros(meet.shape, bool)
        np.put_along_axis(top, ranked, True, axis=1)
        meet &= top
    blocks = np.flatnonzero(meet.any(axis=0))
    asking = [np.flatnonzero(meet[:, k]) for k in blocks]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(blocks), pack)), pa.array([zone[k]["pack"] for k in blocks], pa.int64()),
            pa.array([x.astype(np.int32) for x in asking], pa.list_(pa.int32())),
            pa.array([most[x, k] for x, k in zip(asking, blocks)], pa.list_(pa.float64())),
        ],
        ["chunk", "block", "anchors", "uppers"],
    )


def scanned(chunks: DataFrame, blocks: DataFrame, reads: DataFrame, same: bool, top: int) -> DataFrame:
    """(rid, w, score, vec_id, other): the best ``top`` rows of every window, from the blocks that ``reads`` names."""
    anchors = chunks.select(F.col("pack").alias("chunk"), "dims", *(F.col(c).alias(f"a_{c}") for c in ("rids", "labels", "vecs", "lows", "highs")))
    rows = blocks.select(F.col("pack").alias("block"), *(F.col(c).alias(f"b_{c}") for c in ("rids", "ids", "labels", "vecs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                one = {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}
                a = Chunk(one["a_rids"], one["a_rids"], one["a_labels"], one["a_vecs"], one["dims"], one["a_lows"], one["a_highs"])
                c = Chunk(one["b_rids"], one["b_ids"], one["b_labels"], one["b_vecs"], one["dims"])
                yield best_rows(a, c, np.array(one["anchors"], np.int64), same, top)

    joined = reads.join(anchors, "chunk").join(rows, "block").drop("chunk", "block")
    found = joined.mapInArrow(run, "rid bigint, w int, score bigint, vec_id bigint, other bigint")
    order = Window.partitionBy("rid", "w").orderBy(F.desc("score"), "vec_id", "other")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def best_rows(a: Chunk, c: Chunk, anchors: np.ndarray, same: bool, top: int) -> pa.RecordBatch:
    scores = inner(a.vecs[anchors], c.vecs)
    out: list[list] = [[], [], [], [], []]
    for k, anchor in enumerate(anchors.tolist()):
        allowed = (c.labels == a.labels[anchor]) == same
        if same:
            allowed &= c.rids != a.rids[anchor]
        row = scores[k]
        for w in range(a.lows.shape[1]):
            at = np.flatnonzero(allowed & (row >= a.lows[anchor, w]) & (row <= a.highs[anchor, w]))
            if len(at) > 4 * top and row.dtype != object:
                at = at[row[at] >= np.partition(row[at], len(at) - top)[len(at) - top]]
            at = sorted(at.tolist(), key=lambda j: (-row[j], j))[:top]  # rows of a block are in order of their ids
            out[0] += [int(a.rids[anchor])] * len(at)
            out[1] += [w] * len(at)
            out[2] += [int(row[j]) for j in at]
            out[3] += c.ids[at].tolist()
            out[4] += c.rids[at].tolist()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["rid", "w", "score", "vec_id", "other"])


def searched(stages: Stages, anchors: DataFrame, blocks: DataFrame, maps: DataFrame, same: bool, top: int, windows: int) -> DataFrame:
    """The best rows of every window of ``anchors`` (rid, vec_id, label, dims, key, vec, lows, highs), in two rounds."""
    chunks = stages.keep(packed(anchors, CHUNK_ROWS, windows))
    probe = scanned(chunks, blocks, chosen(chunks, maps, same, PROBE), same, top)
    # a window's lower end rises to the score of its last place, where that is taken; rounded down
    least_score = F.col("score").cast("double") - F.abs(F.col("score").cast("double")) * 1e-15
    raised = probe.filter(F.col("place") == top).groupBy("rid").agg(
        F.map_from_entries(F.collect_list(F.struct("w", least_score.alias("score")))).alias("least")
    )
    tighter = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.get(F.col("found"), w), low)))
    again = anchors.join(raised, "rid", "left").withColumn(
        "found", F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda w: F.element_at("least", w))
    ).withColumn("lows", tighter).drop("least", "found")
    chunks = stages.keep(packed(again, CHUNK_ROWS, windows))
    return scanned(chunks, blocks, chosen(chunks, maps, same), same, top)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = 80, most: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor: over the column ``vec_id``. A negative's score is between ``least`` and ``most`` percent of the
    positive's."""
    stages = Stages(vectors.sparkSession)
    rows = stages.keep(prepared(vectors, id_col, vector_col, label_col).withColumn("rid", F.monotonically_increasing_id()))
    none = F.array().cast("array<double>")
    blocks = stages.keep(packed(rows.withColumn("lows", none).withColumn("highs", none), BLOCK_ROWS, 0).drop("lows", "highs"))
    maps = stages.keep(zones(blocks))
    anchors = rows.filter(is_anchor)
    inf = float("inf")
    whole = anchors.withColumn("lows", F.array(F.lit(-inf))).withColumn("highs", F.array(F.lit(inf)))
    near = stages.keep(searched(stages, whole, blocks, maps, True, positives, 1).select(
        "rid", (F.col("place") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))
    ends = near.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("w", "positive_score"))).alias("scores"))
    score = lambda w: F.element_at("scores", w).cast("decimal(38,0)")
    at = F.sequence(F.lit(0), F.lit(positives - 1))
    windows = anchors.join(ends, "rid").withColumn(
        "lows", F.transform(at, lambda w: F.coalesce(F.ceil(score(w) * least / most).cast("double"), F.lit(inf)))
    ).withColumn("highs", F.transform(at, lambda w: F.coalesce(score(w).cast("double"), F.lit(-inf)))).drop("scores")
    found = searched(stages, windows, blocks, maps, False, negatives, positives)
    return found.join(near, ["rid", "w"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
with usable as (
    select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
    from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
    select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
        list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::bigint as score
    from usable a join usable b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positives as (
    select anchor_id, anchor_label, vec_id as positive_id, score as positive_score from scored where label = anchor_label
    qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, positive_id,
    (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id))::integer as rank,
    s.vec_id as negative_id, positive_score, s.score as negative_score
from positives p join scored s on p.anchor_id = s.anchor_id and s.label <> p.anchor_label
    and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify rank <= 5
"""
