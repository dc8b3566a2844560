"""Spelling variants by range search in k-d trees over letter counts.

A word is a point: how often it has each letter. One inserted or deleted letter moves it by L1 distance one, one
replaced letter by at most two, one count up and one down. So a word's near words lie among those of its own length with
at most one count up and one down, and among those one letter longer with at most one count up. Words one letter
shorter find it the same way.

Trees. For every length a k-d tree over a bounded sample of the words (``SAMPLE_WORDS``) is split at medians until a
leaf stands for about ``LEAF_WORDS`` words. Every word is filed in the leaf of its own length, and sent as a query to
each leaf, of its own length and the next, whose box can be reached within the allowed steps up and down. The sample
only shapes the leaves; results do not depend on it. A task takes one leaf after another, grows the tree on over the
leaf's words down to boxes of ``BOX_WORDS``, and passes the queries through it batch by batch. What is left is compared
by letter counts (unary codes, so that L1 distance is a number of differing bits) and then by the order of the letters.

A leaf returns for each word how many near words it found and the best of them, never the pairs. Counting of words
is combined in each task before the shuffle, so a frequent word costs one row a task. Forms are followed by pointer
doubling: counts at least double at each step, so chains are short.

Defined results: a null text has no words; a null id is written ``null`` in the hash that decides on deletions;
repeated rows are counted each; words of any letters and any length are handled (letters outside the usual alphabet
share one dimension, the order test tells them apart); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, partitions

SAMPLE_WORDS = 200_000
LEAF_WORDS = 16_384
BOX_WORDS = 48
PAIR_BLOCK = 1 << 18
MIN_LETTERS = 5
MIN_COUNT = 3
DROP_EVERY = 97
FLUSH_WORDS = 200_000
BLOCK_BYTES = 1 << 22

#: Lower-cased runs of A-Z, a-z and U+00C0 to U+00FF of at least MIN_LETTERS code points, in UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % MIN_LETTERS)
EDGE = re.compile(rb"[\x00-\x60\x7b-\x7f]")
DIMS = 26 + 64 + 1


# ---- words and their counts


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_every: int = DROP_EVERY, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of the texts, some of them with a letter dropped as a hash of id and word decides."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text")).filter("text is not null")

    def emit(counts: dict[bytes, int]) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        crc, get = zlib.crc32, counts.get
        for b in batches:
            for id_, text in zip(b.column(0), b.column(1)):
                data, at = text.as_py().lower(), 0  # bytes: only A-Z change
                seed = crc(f"{id_.as_py() if id_.is_valid else 'null'}:".encode())
                while at < len(data):
                    edge = EDGE.search(data, at + BLOCK_BYTES)
                    stop = edge.start() if edge else len(data)
                    for word, k in Counter(RUN.findall(data, at, stop)).items():
                        h = crc(word, seed)
                        if not h % drop_every:
                            letters = word.decode()
                            h %= len(letters)
                            word = (letters[:h] + letters[h + 1:]).encode()
                            if len(letters) <= MIN_LETTERS:
                                continue
                        counts[word] = get(word, 0) + k
                    at = stop
                if len(counts) > FLUSH_WORDS:
                    yield emit(counts)
                    counts.clear()
        if counts:
            yield emit(counts)

    found = rows.mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


# ---- points


def letters(words: list[str], length: int) -> np.ndarray:
    """The code points of words of one length, a row for each."""
    return np.array(words, f"<U{length}").view(np.uint32).reshape(len(words), length)


def _table() -> np.ndarray:
    dims = np.full(256, DIMS - 1, np.int64)
    dims[ord("a"):ord("z") + 1] = np.arange(26)
    dims[0xC0:0x100] = np.arange(26, 90)
    return dims


def letter_counts(codes: np.ndarray) -> np.ndarray:
    table, out, rows = _table(), np.zeros((len(codes), DIMS), np.int32), np.arange(len(codes))
    for column in codes.T:
        out[rows, np.where(column < 256, table[np.minimum(column, 255)], DIMS - 1)] += 1
    return out


class Tree:
    """A k-d tree over letter counts. A node is a leaf number, or (dimension, cut, below, above): below has count <= cut."""

    def __init__(self, points: np.ndarray, leaf_size: float):
        self.leaves: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf_size)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf_size: float):
        if len(rows) > leaf_size:
            split = self._split(points[rows])
            if split:
                dim, cut = split
                below = points[rows, dim] <= cut
                return dim, cut, self._grow(points, rows[below], leaf_size), self._grow(points, rows[~below], leaf_size)
        self.leaves.append(rows)
        return len(self.leaves) - 1

    @staticmethod
    def _split(points: np.ndarray) -> tuple[int, int] | None:
        """The cut that comes closest to halving the points."""
        best, found = 0, None
        most = points.max(axis=0)
        for cut in range(int(most.max())):
            below = (points <= cut).sum(axis=0)
            even = np.minimum(below, len(points) - below)
            dim = int(even.argmax())
            if even[dim] > best:
                best, found = int(even[dim]), (dim, cut)
            if not (most > cut + 1).any() or 2 * best >= 0.9 * len(points):
                break
        return found

    def home(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for rows, leaf in self.visit(points, 0, 0):
            out[rows] = leaf
        return out

    def visit(self, points: np.ndarray, up: int, down: int) -> Iterator[tuple[np.ndarray, int]]:
        """(rows, leaf): the points that reach the box of a leaf by at most ``up`` counts up and ``down`` down."""
        zero = np.zeros(len(points), np.int32)
        bounds: dict[int, tuple[int, int | None]] = {}

        def walk(node, rows, ups, downs):
            if not len(rows):
                return
            if isinstance(node, int):
                yield rows, node
                return
            dim, cut, below, above = node
            x = points[rows, dim]
            low, high = bounds.get(dim, (0, None))
            # what this dimension has cost so far, and would cost on either side
            was_up = np.maximum(low - x, 0)
            was_down = np.maximum(x - high, 0) if high is not None else 0
            more_down = downs - was_down + np.maximum(x - cut, 0)
            more_up = ups - was_up + np.maximum(cut + 1 - x, 0)
            keep = more_down <= down
            bounds[dim] = (low, cut)
            yield from walk(below, rows[keep], ups[keep], more_down[keep])
            keep = more_up <= up
            bounds[dim] = (cut + 1, high)
            yield from walk(above, rows[keep], more_up[keep], downs[keep])
            bounds[dim] = (low, high)

        yield from walk(self.root, np.arange(len(points)), zero, zero)


# ---- one edit


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where deleting one letter of ``long`` gives ``short``: common head and tail together cover the short word."""
    head = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= short.shape[1]


def unary(counts: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Counts as bits, ``most`` of each dimension: L1 distance is the number of differing bits."""
    dims = np.repeat(np.arange(len(most)), most)
    level = np.arange(len(dims)) - np.repeat(np.cumsum(most) - most, most)
    bits = counts[:, dims] > level
    width = max(64, -(-len(dims) // 64) * 64)
    padded = np.zeros((len(counts), width), bool)
    padded[:, :len(dims)] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


class Leaf:
    """The words of one leaf, in order, and the tree below."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        texts = words.to_pylist()
        self.words, self.n, self.length = words, counts, len(texts[0])
        self.codes = letters(texts, self.length)
        self.points = letter_counts(self.codes)
        self.tree = Tree(self.points, BOX_WORDS)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) of one edit; queries are of the leaf's length or one letter shorter."""
        points, same = letter_counts(codes), codes.shape[1] == self.length
        most = np.maximum(points.max(axis=0), self.points.max(axis=0))
        q, d = unary(points, most), unary(self.points, most)
        queries, found = [], []
        for rows, leaf in self.tree.visit(points, 1, 1 if same else 0):
            box = self.tree.leaves[leaf]
            step = max(1, PAIR_BLOCK // len(box))
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                far = np.bitwise_count(q[part][:, None, :] ^ d[box][None, :, :]).sum(axis=2, dtype=np.int64)
                i, j = np.nonzero(far <= (2 if same else 1))
                i, j = part[i], box[j]
                ok = one_replaced(codes[i], self.codes[j]) if same else one_inserted(codes[i], self.codes[j])
                queries.append(i[ok])
                found.append(j[ok])
        if not queries:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(queries), np.concatenate(found)


def _summary(words: pa.Array, others: pa.Array, other_n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the pairs (i, j); ``others`` are in code-point order."""
    order = np.lexsort((j, -other_n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
    size = np.diff(np.concatenate([first, [len(i)]]))
    return pa.RecordBatch.from_arrays(
        [words.take(pa.array(i[first])), pa.array(size), pa.array(other_n[j[first]]), others.take(pa.array(j[first]))],
        ["word", "n_near", "best_n", "best"],
    )


# ---- filing words and queries


def grown_trees(words: DataFrame, sample_words: int, leaf_words: int) -> dict[int, Tree]:
    """A tree for each length of the sample."""
    total = words.count()
    share = min(1.0, sample_words / max(total, 1))
    picked = words.filter(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    by_length: dict[int, list[str]] = {}
    for r in picked.select("word").limit(2 * sample_words).collect():
        by_length.setdefault(len(r[0]), []).append(r[0])
    return {k: Tree(letter_counts(letters(sorted(v), k)), leaf_words * share) for k, v in by_length.items()}


def filed(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """(leaf, query, word, n): each word in its leaf, and as a query (1) in the leaves that it can reach."""
    for t in trees.values():
        t.leaves = []  # rows of the sample are not needed any more

    def rows_of(points: np.ndarray, length: int, up: int, down: int) -> Iterator[tuple[np.ndarray, int]]:
        tree = trees.get(length)
        if tree is None:  # a length that the sample has not met is one leaf
            yield np.arange(len(points)), 0
        else:
            yield from tree.visit(points, up, down)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                points = letter_counts(letters([texts[i] for i in rows], length))
                at, leaf, query = [], [], []
                for steps, goal in (((0, 0), length), ((1, 1), length), ((1, 0), length + 1)):
                    for part, number in rows_of(points, goal, *steps):
                        at.append(rows[part])
                        leaf.append(np.full(len(part), goal << 32 | number))
                        query.append(np.full(len(part), int(steps != (0, 0)), np.int32))
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(leaf)), pa.array(np.concatenate(query)), b.column(0).take(take), b.column(1).take(take)],
                    ["leaf", "query", "word", "n"],
                )

    return words.select("word", "n").mapInArrow(run, "leaf bigint, query int, word string, n bigint")


def searched(rows: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): what each leaf finds. A task streams its leaves; words of a leaf come before queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, leaf = None, [], None
        for b in batches:
            leaves, query = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths = np.fromiter(map(len, b.column(2).to_pylist()), np.int64, len(b))
            key = np.stack([leaves, query, np.where(query, lengths, 0)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if lo == hi:
                    continue
                words, n = b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                if leaves[lo] != number:
                    number, held, leaf = leaves[lo], [], None
                if not query[lo]:
                    held.append((words, n))
                    continue
                if not held and leaf is None:
                    continue  # no words in this leaf
                if leaf is None:
                    leaf, held = Leaf(pa.concat_arrays([w for w, _ in held]), np.concatenate([x for _, x in held])), []
                length = int(lengths[lo])
                i, j = leaf.near(letters(words.to_pylist(), length))
                yield _summary(words, leaf.words, leaf.n, i, j)
                if length < leaf.length:
                    yield _summary(leaf.words, words, n, j, i)

    dealt = rows.repartition(partitions(rows.sparkSession), "leaf").sortWithinPartitions("leaf", "query", F.length("word"), "word")
    return dealt.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")


def near_words(words: DataFrame, sample_words: int = SAMPLE_WORDS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n; distinct, not empty) that have near words. best: the near word
    of largest n, the smallest in code-point order on ties."""
    found = searched(filed(words, grown_trees(words, sample_words, leaf_words)))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")
    )


def roots(stages: Stages, forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the length of the steps."""
    steps = stages.keep(forms.select("word", F.col("form").alias("to")))
    while True:
        ahead = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        steps = stages.keep(steps.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if steps.filter("moved").isEmpty():
            return steps.select("word", F.col("to").alias("root"))


def variants(words: DataFrame, sample_words: int = SAMPLE_WORDS, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n)."""
    stages = Stages(words.sparkSession)
    kept = stages.keep(words)
    near = near_words(kept, sample_words, leaf_words)
    known = stages.keep(kept.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= 2 * F.col("n"), F.col("best_n")).alias("form_n"),
    ))
    ends = roots(stages, known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
