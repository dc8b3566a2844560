r"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Two fingerprints link at
``MAX_BITS`` = 3 or fewer differing bits. Candidates come from the perfect binary Golay code [23, 12]:

* The 64 bits are cut into segments of 23, 23 and 18 bits. With at most three errors over three segments there is a
  pair of segments with at most one error each (1+1+1, 2+1+0 and 3+0+0 all have one).
* Every 23-bit word lies within three bits of exactly one codeword. A segment's keys are the codewords of the word
  and of all words one bit away: one key, or six where the word is three bits off its codeword. The word's own
  codeword is among the keys of every word within one bit of it.
* A bucket is (pair of segments, key, key). A fingerprint goes to the buckets of all its key combinations (28 a
  pair at most 36); two are compared where at least one is there by its own codewords, and distances are verified.

Only distinct fingerprints take part, so copies cost nothing. A bucket emits a spanning forest of its links, never
its pairs: a member reached once is not compared again, so a dense bucket costs about its size. Components come
from ``connected_components`` over fingerprints.

``keep_one_of_each`` keeps one row of each component; it tells rows apart by id and text.

Defined results: a null text is the empty text, a text without words has fingerprint zero; a text with fewer words
than a shingle has one shingle, the whole sequence; a null id stays in the result and never names a component if
the fingerprint has another id; repeated rows are kept; an empty table gives an empty result; extra columns are
ignored. Long texts are read in blocks of words, so memory follows the block, not the text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, connected_components, partitions, text_of

MAX_BITS = 3
SEGMENTS = ((0, 23), (23, 23), (46, 18))
GENERATOR = 0b110001110101  # of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SEED = 42
BLOCK_BYTES = 1 << 22
SPACE = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in blocks; a block ends at white space."""
    at = 0
    while at < len(data):
        end = SPACE.search(data, at + BLOCK_BYTES)
        stop = end.start() if end else len(data)
        yield data[at:stop].split()
        at = stop


def shingle_hashes(data: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of all shingles of a text, in blocks; with fewer words than a shingle of the whole sequence."""
    found, carry = False, []
    for words in word_blocks(data.lower()):
        words = carry + words
        if len(words) < width:
            carry = words
            continue
        yield _hashes(words, width)
        found, carry = True, words[len(words) - width + 1:]
    if not found and carry:
        yield _hashes(carry, len(carry))


def fingerprint(data: bytes, width: int = 3, lanes: int = 1) -> np.ndarray:
    """The fingerprint of a text: 64 bits for each lane. The first lane's hash is XXH64, others are mixed from it."""
    counts, total = np.zeros((lanes, 64), np.int64), 0
    for hashes in shingle_hashes(data, width):
        counts, total = _add(hashes, counts, total)
    return np.packbits(counts * 2 > total, axis=1, bitorder="little").view("<u8")[:, 0] if total else np.zeros(lanes, np.uint64)


def _lane(hashes: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return hashes
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())), np.uint64, len(starts)
    )


def _add(hashes: np.ndarray, counts: np.ndarray, total: int) -> tuple[np.ndarray, int]:
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at:at + (1 << 16)]
        lanes = [np.unpackbits(_lane(block, k).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") for k in range(len(counts))]
        counts = counts + np.stack([bits.sum(axis=0, dtype=np.int64) for bits in lanes])
    return counts, total + len(hashes)


def lane_columns(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, lanes: int = 1, digest: bool = False) -> DataFrame:
    """(doc_id, fp, fp1, ..., [digest]): the fingerprint as signed longs, computed where the rows lie; digest: MD5 of the text."""
    names, extra = lane_columns(lanes), ["digest"] if digest else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width, lanes) for t in b.column(1)], np.uint64).reshape(-1, lanes).view(np.int64)
            found = [b.column(0), *(pa.array(fps[:, k].copy()) for k in range(lanes)), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(found, ["doc_id", *names, *extra])

    rows = text_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{n} bigint" for n in names), *(f"{c} binary" for c in extra)])
    text = F.col("text").cast("binary")
    return rows.select("doc_id", text.alias("text"), *(F.unhex(F.md5(text)).alias(c) for c in extra)).mapInArrow(run, schema)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Of each 23-bit polynomial modulo the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - 11), 0)
    return words


class Golay:
    """Nearest codeword of 23-bit words, by tables made from the generator."""

    def __init__(self) -> None:
        self.high = _remainder(np.arange(4096, dtype=np.int64) << 11)
        errors = [0] + [1 << i for i in range(23)]
        errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
        errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        errors = np.array(errors, np.int64)
        self.error = np.zeros(2048, np.int64)
        self.error[_remainder(errors)] = errors

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 message bits of the codeword within three bits of each word."""
        return (words ^ self.error[self.high[words >> 11] ^ (words & 2047)]) >> 11

    def keys(self, words: np.ndarray, bits: int) -> np.ndarray:
        """(n, 6): the codewords of each word and of all words one bit away, -1 where there are fewer."""
        flips = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        out = np.full((len(words), 6), -1, np.int64)
        row, col = np.nonzero(first)
        out[row, (np.cumsum(first, axis=1) - 1)[row, col]] = found[row, col]
        return out


def _segment(fps: np.ndarray, at: int, bits: int) -> np.ndarray:
    """Bits of the fingerprints, counted over the lanes; a segment may reach into the next lane."""
    lane, shift = divmod(at, 64)
    out = fps[:, lane] >> np.uint64(shift)
    if shift + bits > 64:
        out = out | fps[:, lane + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << bits) - 1)).astype(np.int64)


def bucket_rows(fps: DataFrame, segments=SEGMENTS) -> DataFrame:
    """(bucket, fp, ..., own): every fingerprint in all its buckets; own where it is there by its own codewords."""
    names = fps.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in batches:
            fp = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            words = [_segment(fp.view(np.uint64), at, n) for at, n in segments]
            keys = [golay.keys(w, n) for w, (_, n) in zip(words, segments)]
            own = [golay.index(w) for w in words]
            for p, (x, y) in enumerate(itertools.combinations(range(len(segments)), 2)):
                kx, ky = keys[x][:, :, None], keys[y][:, None, :]
                row, i, j = np.nonzero((kx >= 0) & (ky >= 0))
                a, c = keys[x][row, i], keys[y][row, j]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p << 24 | a << 12 | c), *(pa.array(fp[row, k]) for k in range(len(names))), pa.array((a == own[x][row]) & (c == own[y][row]))],
                    ["bucket", *names, "own"],
                )

    return fps.mapInArrow(run, ", ".join(["bucket bigint", *(f"{n} bigint" for n in names), "own boolean"]))


def _bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def spanning_links(fps: np.ndarray, max_bits: int) -> np.ndarray:
    """A spanning forest, (n, 2, lanes), of the links between distinct fingerprints (n, lanes); members reached are
    not compared again."""
    left, links = np.unique(fps, axis=0), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _bits_apart(left, x) <= max_bits
            if near.any():
                hits = left[near]
                links.append(np.stack([np.broadcast_to(x, hits.shape), hits], axis=1))
                frontier += list(hits)
                left = left[~near]
    return np.concatenate(links) if links else np.empty((0, 2, fps.shape[1]), np.uint64)


SMALL = 16


def _links(bucket: np.ndarray, fp: np.ndarray, own: np.ndarray, max_bits: int) -> np.ndarray:
    """Links (n, 2, lanes) of whole buckets, rows sorted by bucket."""
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.concatenate([start, [len(bucket)]]))
    found = [spanning_links(fp[s:s + n], max_bits) for s, n in zip(start[size > SMALL], size[size > SMALL])]
    few = np.repeat((size > 1) & (size <= SMALL), size)
    bucket, fp, own = bucket[few], fp[few], own[few]
    for s in range(1, SMALL):
        met = np.flatnonzero((bucket[s:] == bucket[:-s]) & (own[s:] | own[:-s]))
        near = met[_bits_apart(fp[met + s], fp[met]) <= max_bits]
        found.append(np.stack([fp[near + s], fp[near]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def bucket_links(rows: DataFrame, max_bits: int = MAX_BITS, all_keys: bool = False) -> DataFrame:
    """(a, a1, ..., b, b1, ...): verified links that connect each bucket. A task streams its buckets in order.
    ``all_keys``: compare any two of a bucket, not only where one is there by its own codewords."""
    names = rows.columns[1:-1]
    lanes = len(names)
    ends = [n.replace("fp", side) for side in "ab" for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.empty(0, np.int64), np.empty((0, lanes), np.uint64), np.empty(0, bool)]

        def emit(columns):
            links = _links(*columns, max_bits).view(np.int64).reshape(-1, 2 * lanes)
            return pa.RecordBatch.from_arrays([pa.array(links[:, k].copy()) for k in range(2 * lanes)], ends)

        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            new = [columns[0], np.stack(columns[1:-1], axis=1).view(np.uint64), columns[-1] | all_keys]
            rest = [np.concatenate(x) for x in zip(rest, new)]
            cut = int(np.searchsorted(rest[0], rest[0][-1])) if len(rest[0]) else 0  # the last bucket may go on
            if cut:
                yield emit([x[:cut] for x in rest])
                rest = [x[cut:] for x in rest]
        if len(rest[0]):
            yield emit(rest)

    n = partitions(rows.sparkSession)
    dealt = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, ", ".join(f"{e} bigint" for e in ends)).distinct()


def grouped(rows: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, group, component_id) for every fingerprint of ``rows`` (doc_id, fp): a name of its component, and the
    smallest id there. Nodes are fingerprints, not ids, so an id with several texts connects nothing."""
    stages = Stages(rows.sparkSession)
    reps = stages.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = stages.keep(bucket_links(bucket_rows(reps.select("fp")), max_bits))
    found = connected_components(links)
    nodes = reps.join(found, reps["fp"] == found["id"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("group"))
    least = nodes.groupBy("group").agg(F.min("rep").alias("component_id"))
    return nodes.select("fp", "group").join(least, "group")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest id reachable over links, the row's own included."""
    rows = Stages(docs.sparkSession).keep(fingerprints(docs, id_col, text_col, width))
    return rows.join(grouped(rows, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, one of each component: that of the smallest id, of
    several texts with this id the one of the least digest, of equal rows any one. Rows with a null id all stay."""
    stages = Stages(docs.sparkSession)
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), digest.alias("digest"))
    rows = stages.keep(fingerprints(docs, id_col, text_col, width, digest=True).filter("doc_id is not null"))
    me, own = F.struct("doc_id", "digest"), ["doc_id", "digest"]
    members = stages.keep(rows.join(grouped(rows, max_bits).select("fp", "group"), "fp").groupBy("group", *own).count())
    stays = members.groupBy("group").agg(F.min(me).alias("stays"))
    gone = members.join(stays, "group").filter(me != F.col("stays")).select(own)
    kept = whole.join(gone, own, "left_anti")
    repeated = members.filter("count > 1").select(own)
    if repeated.isEmpty():
        return kept.select("row.*")
    once = kept.join(repeated, own, "left_anti").select("row.*")
    twice = kept.join(repeated, own, "left_semi").groupBy(own).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(twice.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
