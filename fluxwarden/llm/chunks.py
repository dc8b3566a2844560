"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes (window 32). Chunks end by normalised chunking: up to ``NORMAL`` bytes only at
positions where the top six hash bits are zero, then at those where the top three are, at ``MAX`` at the latest, and
never before ``MIN``. Boundaries depend on the bytes around them only, so an insertion moves few chunks. The
fingerprint is the sorted set of chunk tokens (32 bits of digest, 8 bits of length) in hex. The likeness of two
fingerprints is their containment by length: bytes of shared chunks over those of the smaller set, 1 for two empty
ones and 0 for one empty one.

``with_next`` hands every document its successor in ascending id. Ids are cut into ranges by quantiles; a range goes
to one task, sorted, together with the first document of the next range. The text is shuffled once, no window spans
the table, and a task holds two documents at a time.

Defined results: a null text is the empty text (empty fingerprint); ids tie by text, repeated rows follow each other;
null ids come first; the last document is followed by the first, a single one by itself; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import partitions, text_of

MIN, NORMAL, MAX = 16, 40, 160
STRICT, LOOSE = 6, 3
BLOCK_BYTES = 1 << 20
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 0) for i in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last 32 bytes, by doubling the window."""
    h = GEAR[data]
    for s in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[s:] += h[:-s] << np.uint32(s)
        h = wider
    return h


def cuts(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks."""
    n, start = len(data), 0
    while start < n:
        stop = min(n, start + BLOCK_BYTES + MAX)
        base = max(0, start - 31)
        h = gear_hash(np.frombuffer(data, np.uint8, stop - base, base))
        loose = np.flatnonzero(h < 1 << (32 - LOOSE))
        strict = loose[h[loose] < 1 << (32 - STRICT)]
        loose, strict = (loose + base + 1).tolist(), (strict + base + 1).tolist()  # a chunk ends behind the position
        while start < n and (start + MAX <= stop or stop == n):
            k = bisect.bisect_left(strict, start + MIN)
            end = strict[k] if k < len(strict) else n
            if end > start + NORMAL:
                k = bisect.bisect_left(loose, start + NORMAL)
                end = loose[k] if k < len(loose) else n
            end = min(end, start + MAX, n)
            yield start, end
            start = end


def tokens(data: bytes) -> np.ndarray:
    """The sorted set of chunk tokens of a text."""
    digest = xxhash.xxh32_intdigest
    found = [digest(data[a:b], 1) << 8 | b - a for a, b in cuts(data)]
    return np.unique(np.array(found, np.uint64))


def as_hex(token: np.ndarray) -> str:
    return token.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment by length of two token sets."""
    weight = lambda t: int((t & np.uint64(255)).sum())
    least = min(weight(a), weight(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / least if least else float(len(a) == len(b))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, halo, doc_id, text), hash-partitioned by bucket and sorted: a bucket's documents in order, then
    (halo = 1) the candidates for the one after its last."""
    rows = text_of(docs, id_col, text_col)
    n = 4 * partitions(docs.sparkSession)
    bounds = np.array(sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.25 / n))))

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.to_numpy(dtype=float, na_value=-np.inf)) + 1))

    least = rows.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.min("doc_id").alias("low"))
    found = sorted((r.bucket, r.low) for r in least.collect())  # a row for each bucket
    before = {found[k][0]: (found[k - 1][0], found[k][1]) for k in range(len(found))}  # [-1]: the last precedes the first

    @F.pandas_udf("long")
    def halo_of(buckets: pd.Series, ids: pd.Series) -> pd.Series:
        """The bucket before, for a document that is the first of its own; bucket 0 has the null ids."""
        low = [before[b] for b in buckets]
        return pd.Series([p if b == 0 or i == v else None for b, i, (p, v) in zip(buckets, ids, low)], dtype="Int64")

    dealt = rows.withColumn("bucket", bucket("doc_id")).withColumn("halo_of", halo_of("bucket", "doc_id"))
    places = F.array_compact(F.array(
        F.struct(F.col("bucket"), F.lit(0).alias("halo")),
        F.when(F.col("halo_of").isNotNull(), F.struct(F.col("halo_of").alias("bucket"), F.lit(1).alias("halo"))),
    ))
    return (
        dealt.select(F.explode(places).alias("place"), "doc_id", "text").select("place.bucket", "place.halo", "doc_id", "text")
        .repartition(partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint): where the rows lie, without a shuffle."""
    rows = text_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            marks = [as_hex(tokens(t.encode())) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(marks, pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars bigint, fingerprint string")


def edited_half(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next document."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's fingerprint, that of its edited text, and the likeness of both and of the next document."""
    rows = with_next(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, doc_id, text, tokens)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for bucket, halo, id_, text in zip(*(c.to_pylist() for c in b.columns)):
                if halo and (held is None or held[0] != bucket):
                    continue  # the place after the bucket's last document is taken
                mark = tokens(text.encode())
                if held is not None and held[0] == bucket:
                    edited = edited_half(held[2], text).encode()
                    other = tokens(edited)
                    for column, value in zip(out, (
                        held[1], len(held[2]), hashlib.sha256(edited).hexdigest(), as_hex(held[3]), as_hex(other),
                        likeness(held[3], other), likeness(held[3], mark),
                    )):
                        column.append(value)
                held = None if halo else (bucket, id_, text, mark)
            types = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
