"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

A document becomes its token ids and an end id. Only documents longer than the capacity are cut, into full pieces
and one rest. Pieces are packed by large-item matching: pieces above a third of the capacity stand at most two to a
sequence and are paired greedily (largest first, each with the largest piece that still fits); the others follow in
falling size, each into the fullest sequence that has room.

The packing depends only on how many pieces there are of each length. So the corpus is reduced to a histogram of at
most ``capacity`` rows, the packing is decided for whole groups of equal sequences at once, and every piece finds
its place from (length, rank among the pieces of that length). The plan is a table of bounded size: it has a row for
each slot of each kind of sequence, whatever the number of documents.

Ranks: a length may hold a large share of all pieces. Pieces of a length are spread over ``spread`` parts by a hash;
a part's pieces are numbered in the part, and parts are offset by their counts.

Defined results: a null text is the empty text and still gives the end id; repeated rows are packed each (ranks
break ties by document, piece and checksum); a null id is kept; an empty table gives an empty result; extra columns
are ignored. Sequence numbers have no meaning besides telling sequences apart.
"""

from __future__ import annotations

import bisect
import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluxwarden.llm.common import Stages, partitions, text_of

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 400_000
BLOCK_BYTES = 1 << 22
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = re.compile(rb"[\x20\x09-\x0d]")
PIECES = "doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordEncoder:
    """Token ids of texts by words. The vocabulary drops white space and no token crosses it, so the ids of a text
    are those of its words in order. Nor does a token cross from a letter or digit to punctuation behind it, so a
    word's ids are those of its stem and its tail. Ids seen before come from two tables of bounded size, by word as
    written and by stem; stems of plain letters are lower-cased first, as the vocabulary does with every text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [t.endswith("</w>") for t, _ in sorted(self.tokenizer.get_vocab().items(), key=lambda x: x[1])]
        self.ends_word = np.array(ends)
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}

    @staticmethod
    def of_process(path: str) -> WordEncoder:
        """The encoder of this worker process, which serves one task after another."""
        holder = sys.modules.setdefault("_word_encoders", types.ModuleType("_word_encoders"))
        if path not in holder.__dict__:
            holder.__dict__[path] = WordEncoder(path)
        return holder.__dict__[path]

    def forget(self) -> None:
        """Free the tables at a task's end: the worker goes on to other stages, and a task meets more words than they hold."""
        self.words, self.stems = {}, {}

    def blocks(self, data: bytes) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, in blocks that end at white space."""
        at = 0
        while at < len(data):
            end = SPACE.search(data, at + BLOCK_BYTES)
            stop = end.start() if end else len(data)
            words = data[at:stop].split()
            at = stop
            table = self.words
            new = {w for w in words if w not in table}
            if new:
                if len(table) > CACHE_WORDS:
                    table.clear()
                    new = set(words)
                self._learn(new)
            yield b"".join(map(table.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        if len(self.stems) > CACHE_WORDS:
            self.stems.clear()
        stems, parts = self.stems, []
        for w in words:
            stem = w.rstrip(PUNCTUATION)
            if b"<|" in w:
                parts.append((w, w, b""))
            elif stem.isascii():
                if stem and not stem[-1:].isalnum():  # a control character before the punctuation
                    parts.append((w, w, b""))
                    continue
                parts.append((w, stem.lower(), w[len(stem):]))
            else:
                text = stem.decode("utf-8", "replace")
                if unicodedata.category(text.lower()[-1])[0] not in "LN":
                    parts.append((w, w, b""))  # what stands before the punctuation may belong to it
                else:
                    tail = w[len(stem):]
                    if text.isalpha() and max(text) <= "\xff":  # letters with plain lower case
                        stem = text.lower().encode()
                    parts.append((w, stem, tail))
        self._encode({x for _, *both in parts for x in both if x not in stems})
        for w, stem, tail in parts:
            self.words[w] = stems[stem] + stems[tail]

    def _encode(self, new: set[bytes]) -> None:
        letters, others = [], []
        for x in new:
            text = x.decode("utf-8", "replace")
            (letters if text.isalpha() else others).append((x, text))
        if letters:  # a word of letters is one word of the vocabulary's too, as a rule
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(t for _, t in letters)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(letters):
                raw, at = ids.tobytes(), 0
                for (x, _), end in zip(letters, (4 * ends).tolist()):
                    self.stems[x] = raw[at:end]
                    at = end
            else:
                others += letters
        for (x, _), e in zip(others, self.tokenizer.encode_batch_fast([t for _, t in others], add_special_tokens=False)):
            self.stems[x] = np.array(e.ids, "<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document, computed where the rows lie.

    ``ids`` (binary, unsigned 32-bit) is what a trainer writes; the packing itself does not move it."""
    rows = text_of(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    step = 4 * capacity
    end = np.array([end_id], "<u4").tobytes()

    def cut(encoder: WordEncoder, data: bytes) -> Iterator[bytes]:
        held = b""
        for block in encoder.blocks(data):
            held += block
            full = len(held) // step * step  # the end id still follows
            for at in range(0, full, step):
                yield held[at:at + step]
            held = held[full:]
        yield held + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_process(vocabulary)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for id_, text in zip(b.column(0), b.column(1)):
                for k, ids in enumerate(cut(encoder, text.as_py())):
                    for column, value in zip(out, (id_.as_py(), k, k * capacity, len(ids) // 4, zlib.crc32(ids))):
                        column.append(value)
                    if with_ids:
                        out[5].append(ids)
            types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
        encoder.forget()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, PIECES.format(kind=kind) + (", ids binary" if with_ids else ""))


def plan_sequences(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first_rank, end_rank, first_sequence, copies, offset).

    Of the pieces of ``length``, rank r in [first_rank, end_rank) goes to sequence
    first_sequence + (r - first_rank) // copies, at offset + (r - first_rank) % copies * length.
    A group is a number of equal sequences: (gap, count, [(length, copies)...])."""
    left = {n: c for n, c in histogram.items() if c}
    groups: list[tuple[int, int, tuple]] = []
    third = capacity // 3
    large = sorted((n for n in left if n > third), reverse=True)
    for n in large:
        while left[n]:
            partner = next((m for m in large if m <= capacity - n and left[m] > (m == n)), 0)
            if not partner:
                groups.append((capacity - n, left[n], ((n, 1),)))
                left[n] = 0
            elif partner == n:
                groups.append((capacity - 2 * n, left[n] // 2, ((n, 2),)))
                left[n] %= 2
            else:
                k = min(left[n], left[partner])
                groups.append((capacity - n - partner, k, ((n, 1), (partner, 1))))
                left[n] -= k
                left[partner] -= k
    by_gap: dict[int, list] = {}
    for gap, count, held in groups:
        by_gap.setdefault(gap, []).append((count, held))
    gaps = sorted(by_gap)
    for n in sorted((n for n in left if n <= third), reverse=True):
        count = left[n]
        while count:
            at = bisect.bisect_left(gaps, n)
            if at == len(gaps):
                gap, sequences, held = capacity, -(-count // (capacity // n)), ()
            else:
                gap = gaps[at]
                sequences, held = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap]
                    gaps.remove(gap)
            copies = min(gap // n, count)
            full = min(sequences, count // copies)
            parts = [(gap - copies * n, full, (*held, (n, copies)))]
            if sequences > full:
                parts.append((gap, sequences - full, held))
            count -= full * copies
            for rest, number, content in parts:
                if rest == capacity:
                    continue  # not opened yet: the next round opens what it needs
                if rest not in by_gap:
                    by_gap[rest] = []
                    bisect.insort(gaps, rest)
                by_gap[rest].append((number, content))
    slots, ranks, sequence = [], {}, 0
    for gap in sorted(by_gap):
        for number, held in by_gap[gap]:
            offset = 0
            for n, copies in held:
                first = ranks.get(n, 0)
                ranks[n] = first + number * copies
                slots.append((n, first, ranks[n], sequence, copies, offset))
                offset += n * copies
            sequence += number
    return slots


def ranked(pieces_: DataFrame, spread: int) -> DataFrame:
    """Pieces with their rank among those of equal length, from 0 without gaps."""
    parts = pieces_.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    offsets = parts.groupBy("length", "part").count().select(
        "length", "part",
        (F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).alias("before"),
    )  # at most ``spread`` rows a length
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    return parts.withColumn("inside", inside).join(offsets, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.col("inside") - 1
    ).drop("part", "inside", "before")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    spark = docs.sparkSession
    rows = Stages(spark).keep(pieces(docs, vocabulary, id_col, text_col, capacity, end_id))
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most capacity rows
    slots = np.array(sorted(plan_sequences(histogram, capacity)), np.int64).reshape(-1, 6)
    spread = max(64, sum(histogram.values()) // 200_000)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = slots[:, 0] << 48 | slots[:, 1]
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            s = slots[np.searchsorted(starts, length << 48 | rank, side="right") - 1] if len(length) else slots[:0]
            k = rank - s[:, 1]
            columns = [b.column(i) for i in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(s[:, 3] + k // s[:, 4]), pa.array(s[:, 5] + k % s[:, 4] * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows, spread).mapInArrow(place, PIECES.format(kind=kind) + ", sequence_id bigint, offset bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
