"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a string of ``length`` bytes that also starts anywhere else, in any document or the same one,
is removed; strings are judged on the input. Texts are UTF-8 bytes and matches never cross documents.

1. Anchors. A string of ``length`` bytes has one anchor: the ``GRAM``-byte piece with the least hash, the leftmost on
   ties. Equal strings have equal anchors at equal places, so a repeated string's anchors meet in one group. Anchors
   are about one in 180 bytes; only their hashes are shuffled.
2. Contexts. An anchor's context is the bytes that any string with this anchor can cover. Equal contexts are counted
   by hash (combined before the shuffle): where one occurs twice, all its strings repeat, which settles copies and
   the inside of shared passages. Only anchors with several different contexts go on, one context of each kind.
3. Suffix sort. A task holds whole anchor groups. The suffixes at the anchors are ordered by a mergesort whose
   comparisons find the common extension by binary search over prefix polynomial hashes (of words of eight bytes,
   then the byte in the word), and so are the reversed
   prefixes. Neighbours in these orders give what any two members share behind and before the anchor, and with it
   the runs of windows that repeat. Matches found by the sort are verified byte by byte.
4. Anchors with more than ``hot`` different contexts (edges of a passage that very many documents have)
   are not gathered: their windows are parted by halving the range of starts, and grouped by the bytes that all windows
   of a half share (128-bit hash), until a group has at most ``hot`` contexts and is sorted as above.

Hashes stand for bytes in three places: equal texts by MD5, equal contexts of one anchor by 64 bits (and the 40 bits
of the anchor's own hash), stretches of contexts of hot anchors by 128 bits.

With ``words`` the passages of so many words (parted by white space, whatever its kind and amount) that also start
anywhere else go as well, from the first word to the last, however few bytes they have: the same search runs over the
64-bit hashes of the words, and only the starts at a word count. Both rules judge the input. Here words are told by hash.

Defined results: a null text is the empty text; texts shorter than ``length`` lose nothing; of repeated rows and
copies every byte goes, as each has another start elsewhere; null ids are kept; an empty table gives an empty result;
extra columns are ignored by ``dedup`` and kept by ``remove_repeats``. Texts are hashed in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, free_names, partitions, release

LENGTH = 400
GRAM = 32
HOT = 4_000
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 1 << 22
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
CODE_BYTES = 8


def _powers(base: int, n: int, known: dict = {}) -> np.ndarray:  # noqa: B006
    """base^0 .. base^(n-1) modulo 2^64; the longest so far is kept."""
    if base not in known or len(known[base]) < n:
        powers = np.full(max(n, 1 << 16), base, np.uint64)
        powers[0] = 1
        known[base] = np.multiply.accumulate(powers)
    return known[base][:n]


class Hashes:
    """Prefix polynomial hashes of a byte buffer, modulo 2^64."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, n), out=self.prefix[1:])
        self.shift = _powers(INVERSE, n + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of ``length`` bytes."""
    n, w, places, values = len(data), length - gram + 1, [], []
    low = np.uint64((1 << 24) - 1)
    for at in range(0, n - length + 1, BLOCK_BYTES):
        windows = min(BLOCK_BYTES, n - length + 1 - at)
        h = Hashes(np.frombuffer(data, np.uint8, windows + length - 1, at))
        value = _mix((h.prefix[gram:] - h.prefix[:-gram]) * h.shift[:len(h.prefix) - gram])
        # the place in the low bits makes the leftmost of equal hashes the least
        packed = (value & ~low) | np.arange(len(value), dtype=np.uint64)
        padded = np.full(-(-len(packed) // w) * w, np.iinfo(np.uint64).max, np.uint64)
        padded[:len(packed)] = packed
        rows = padded.reshape(-1, w)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:windows], before[w - 1:w - 1 + windows])
        first = np.concatenate([[True], least[1:] != least[:-1]])
        place = (least[first] & low).astype(np.int64)
        places.append(place + at)
        values.append(value[place])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    place, value = np.concatenate(places), np.concatenate(values)
    place, first = np.unique(place, return_index=True)
    return place, value[first]


class Side:
    """What follows the anchor of each member (or, reversed, precedes it): eight bytes to a word, and the polynomial
    hash of every prefix of words. All texts begin at the anchor, so equal prefixes have equal hashes."""

    def __init__(self, texts: list[bytes]):
        self.room = np.fromiter(map(len, texts), np.int64, len(texts))
        width = int(-(-self.room.max(initial=1) // 8))
        self.words = np.frombuffer(b"".join(t.ljust(8 * width, b"\0") for t in texts), ">u8").astype(np.uint64).reshape(-1, width)
        self.prefix = np.zeros((len(texts), width + 1), np.uint64)
        power = _powers(BASE, width)
        for k in range(width):
            self.prefix[:, k + 1] = self.prefix[:, k] + _mix(self.words[:, k] + np.uint64(1)) * power[k]

    def common(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that members a and b share, and the first word in which they differ: binary search over hashes."""
        width = self.words.shape[1]
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), width)
        while (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.prefix[a, mid] == self.prefix[b, mid]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        word = np.minimum(lo, width - 1)
        x = self.words[a, word] ^ self.words[b, word]
        for shift in (1, 2, 4, 8, 16, 32):  # all bits behind the first
            x = x | x >> np.uint64(shift)
        shared = 8 * word + (64 - np.bitwise_count(x).astype(np.int64)) // 8
        return np.minimum(shared, np.minimum(self.room[a], self.room[b])), word

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a comes before b; the shorter one does where it is a prefix."""
        shared, word = self.common(a, b)
        ended = shared == np.minimum(self.room[a], self.room[b])
        return np.where(ended, self.room[a] < self.room[b], self.words[a, word] < self.words[b, word])

    def sorted(self, group: np.ndarray) -> np.ndarray:
        """Mergesort of the members of every group at once; a row finds its rank in the sibling run by bisection."""
        n = len(group)
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.empty(0, np.int64)
        size = np.diff(np.concatenate([start, [n]]))
        begin, total = np.repeat(start, size), np.repeat(size, size)
        local, order, width = np.arange(n) - begin, np.arange(n), 1
        while n and width < size.max():
            run = local // width
            right = run % 2 == 1
            lo = begin + np.minimum((run + np.where(right, -1, 1)) * width, total)
            hi = np.minimum(lo + width, begin + total)
            sibling = lo.copy()
            active = np.flatnonzero(lo < hi)
            while len(active):
                mid = (lo[active] + hi[active]) >> 1
                other, own, goes = order[mid], order[active], right[active]
                less = self.less(np.where(goes, own, other), np.where(goes, other, own))
                up = less != goes  # a right row goes behind equal left rows
                lo[active] = np.where(up, mid + 1, lo[active])
                hi[active] = np.where(up, hi[active], mid)
                active = active[lo[active] < hi[active]]
            after = np.empty(n, np.int64)
            after[begin + (run - right) * width + local - run * width + lo - sibling] = order
            order, width = after, width * 2
        return order


class Contexts:
    """Contexts of anchor groups, sorted by group."""

    def __init__(self, group: np.ndarray, left: np.ndarray, pieces: list[bytes], length: int):
        self.length, self.pieces, self.left = length, pieces, left
        self.right = np.fromiter(map(len, pieces), np.int64, len(pieces)) - left
        self.first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.members = np.diff(np.concatenate([self.first, [len(group)]]))
        self.group = np.repeat(np.arange(len(self.first)), self.members)

    def order(self, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """The members sorted by group and by what follows (or, reversed, precedes) their anchor, and how much of it
        each shares with the member before it in this order (0 for the first of a group)."""
        side = Side([p[x:] if forward else p[:x][::-1] for p, x in zip(self.pieces, self.left.tolist())])
        order = side.sorted(self.group)
        shared = np.zeros(len(order), np.int64)
        x, y = order[:-1], order[1:]
        pair = np.flatnonzero(self.group[x] == self.group[y])
        shared[pair + 1] = side.common(x[pair], y[pair])[0]
        return order, shared

    def repeats(self, settled: np.ndarray, gram: int) -> list[list[tuple[int, int]]]:
        """Runs (first, last) of starts, relative to the anchor, whose windows repeat in the group; only for members
        that are not settled.

        A member that shares ``left`` bytes before and ``right`` bytes behind the anchor makes the starts from -left
        to right - length repeat. Each member is left by two walks: in the order of reversed prefixes, which meets the
        others by falling ``left``, and in the order of suffixes, by falling ``right``; the other side's shared length
        is a range minimum. What neither walk has met shares less on both sides than the walks do now, so a member is
        done when all starts that this leaves are known to repeat, or none is left."""
        runs: list[list[tuple[int, int]]] = [[] for _ in self.pieces]
        n, length = len(self.pieces), self.length
        first, last = -np.minimum(self.left, length - gram), np.minimum(0, self.right - length)
        begin = self.first[self.group]
        end = begin + self.members[self.group]  # a group has the same places in every order
        walks = [Walk(*self.order(False), begin, end), Walk(*self.order(True), begin, end)]
        member = np.flatnonzero(~settled & (first <= last) & (end - begin > 1))
        for walk in walks:
            walk.start(member)
        cover_lo, cover_hi = np.ones(len(member), np.int64), np.zeros(len(member), np.int64)  # a run known to repeat
        while len(member):
            bounds = []
            for mine, theirs in (walks, walks[::-1]):
                other, shared = mine.step(member)
                bounds.append(np.maximum(shared, 0))
                across = np.where(shared >= 0, theirs.shared_by(member, other), 0)
                left, right = (shared, across) if mine is walks[0] else (across, shared)
                lo, hi = np.maximum(-left, first[member]), np.minimum(right - length, last[member])
                for k in np.flatnonzero((shared >= 0) & (lo <= hi) & ((lo < cover_lo) | (hi > cover_hi))).tolist():
                    m = int(member[k])
                    x, y = self._verified(m, int(other[k]), int(left[k]), int(right[k]))
                    x, y = max(-x, int(first[m])), min(y - length, int(last[m]))
                    if x > y:
                        continue
                    runs[m].append((x, y))
                    if cover_lo[k] > cover_hi[k] or x <= cover_hi[k] + 1 and y >= cover_lo[k] - 1:
                        known = cover_lo[k] <= cover_hi[k]
                        cover_lo[k], cover_hi[k] = (min(x, cover_lo[k]), max(y, cover_hi[k])) if known else (x, y)
            lo, hi = np.maximum(-bounds[0], first[member]), np.minimum(bounds[1] - length, last[member])
            going = (lo <= hi) & ((lo < cover_lo) | (hi > cover_hi)) & walks[0].unmet() & walks[1].unmet()
            if not going.all():
                member, cover_lo, cover_hi = member[going], cover_lo[going], cover_hi[going]
                for walk in walks:
                    walk.keep(going)
        return runs

    def _verified(self, m: int, o: int, left: int, right: int) -> tuple[int, int]:
        """What two members share on both sides of the anchor, by the bytes themselves."""
        a, b = ((self.pieces[x][int(self.left[x]) - left:int(self.left[x])][::-1], self.pieces[x][int(self.left[x]):int(self.left[x]) + right]) for x in (m, o))
        sizes = []
        for x, y in zip(a, b):
            same = np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8) if x != y else None
            sizes.append(len(x) if same is None else int(same.argmin()))
        return sizes[0], sizes[1]


class Walk:
    """Members met outward from each of some members in a sorted order, by falling shared length."""

    def __init__(self, order: np.ndarray, shared: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.order, self.begin, self.end = order, begin, end
        self.before, self.least = np.append(shared, 0), RangeMinimum(shared)
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.arange(len(order))

    def start(self, member: np.ndarray) -> None:
        self.down, self.up = self.place[member], self.place[member]  # the places met so far
        self.first, self.last = self.begin[member], self.end[member] - 1
        self.least_down, self.least_up = (np.full(len(member), 1 << 30) for _ in range(2))

    def step(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next member met by each, and the length that both share; -1 where all are met."""
        down = np.where(self.down > self.first, np.minimum(self.least_down, self.before[self.down]), -1)
        up = np.where(self.up < self.last, np.minimum(self.least_up, self.before[self.up + 1]), -1)
        below, shared = down >= up, np.maximum(down, up)
        moves = shared >= 0
        self.down = self.down - (moves & below)
        self.up = self.up + (moves & ~below)
        self.least_down = np.where(moves & below, shared, self.least_down)
        self.least_up = np.where(moves & ~below, shared, self.least_up)
        return self.order[np.where(below, self.down, self.up)], shared

    def unmet(self) -> np.ndarray:
        return (self.down > self.first) | (self.up < self.last)

    def shared_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length that members a and b share in this order; a and b differ, or the value has no use."""
        x, y = self.place[a], self.place[b]
        return self.least.between(x, np.where(x == y, np.where(x > 0, x - 1, x + 1), y))

    def keep(self, going: np.ndarray) -> None:
        for name in ("down", "up", "first", "last", "least_down", "least_up"):
            setattr(self, name, getattr(self, name)[going])


class RangeMinimum:
    """Least value between two places of an array, from tables of the least of 2^k values."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 << (len(self.tables) - 1) <= len(values):
            half, last = 1 << (len(self.tables) - 1), self.tables[-1]
            self.tables.append(np.minimum(last[:-half], last[half:]))
        size = max(len(t) for t in self.tables)
        self.table = np.zeros((len(self.tables), size), values.dtype)
        for k, t in enumerate(self.tables):
            self.table[k, :len(t)] = t

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the values behind the smaller place, up to the greater one; the places differ."""
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        k = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(self.table[k, lo], self.table[k, hi - (1 << k)])


def word_codes(data: bytes) -> bytes:
    """The hashes of the words of a text, ``CODE_BYTES`` each."""
    return np.fromiter(map(xxhash.xxh64_intdigest, data.split()), np.uint64).tobytes()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.md5("text")))


ANCHORS = "digest binary, pos int, anchor bigint, ctx bigint, `left` int, `right` int"
SPANS = "array<struct<lo:int,hi:int>>"


def _anchor_rows(texts: DataFrame, length: int, gram: int, code: Callable[[bytes], bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            out, taken = [[] for _ in range(5)], []
            for k, text in enumerate(b.column(1)):
                data = code(text.as_py())
                place, value = anchors(data, length, gram)
                left, right = np.minimum(place, length - gram), np.minimum(len(data) - place, length)
                ctx = [digest(data[p - x:p + y], x) for p, x, y in zip(place.tolist(), left.tolist(), right.tolist())]
                for column, found in zip(out, (place, value, np.array(ctx, np.uint64), left, right)):
                    column.append(found)
                taken.append(np.full(len(place), k))
            if not taken:
                continue
            place, value, ctx, left, right = map(np.concatenate, out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.concatenate(taken))), pa.array(place.astype(np.int32)), pa.array(value.view(np.int64)),
                 pa.array(ctx.view(np.int64)), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                ["digest", "pos", "anchor", "ctx", "left", "right"],
            )

    return texts.select("digest", "text").mapInArrow(run, ANCHORS)


def _context_rows(texts: DataFrame, code: Callable[[bytes], bytes]) -> DataFrame:
    """(anchor, ctx, left, multi, bytes) from (text, wanted: structs of anchor, ctx, pos, left, right, multi)."""

    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["anchor", "ctx", "left", "multi", "bytes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for text, wanted in zip(b.column(0), b.column(1)):
                data = code(text.as_py())
                for w in wanted.as_py():
                    rows.append((w["anchor"], w["ctx"], w["left"], w["multi"], data[w["pos"] - w["left"]:w["pos"] + w["right"]]))
                    size += len(rows[-1][4])
                    if size > GROUP_BYTES:  # many contexts to a text: no batch of all of them
                        yield batch(rows)
                        rows, size = [], 0
            yield batch(rows)

    return texts.select("text", "wanted").mapInArrow(run, "anchor bigint, ctx bigint, `left` int, multi boolean, bytes binary")


def _sorted_groups(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, ctx, spans) of whole groups (of an anchor, or by the column ``group``); a task works on some megabytes of
    groups at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        group = np.array([r[0] for r in rows], np.int64)
        found = Contexts(group, np.array([r[2] for r in rows], np.int64), [r[4] for r in rows], length).repeats(np.array([r[3] for r in rows]), gram)
        has = [k for k, runs in enumerate(found) if runs]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k][5] for k in has], pa.int64()), pa.array([rows[k][1] for k in has], pa.int64()),
             pa.array([[{"lo": a, "hi": c} for a, c in found[k]] for k in has], pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))],
            ["anchor", "ctx", "spans"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for columns in _slices(batches):
            for row in zip(*columns):
                if held and held[-1][:2] == row[:2]:
                    continue  # one context of each kind
                if size > GROUP_BYTES and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield solve(held)

    group = F.col("group" if "group" in contexts.columns else "anchor").alias("group")
    dealt = contexts.select(group, "ctx", "left", "multi", "bytes", "anchor").repartition(partitions(contexts.sparkSession), "group")
    return dealt.sortWithinPartitions("group", "ctx").mapInArrow(run, f"anchor bigint, ctx bigint, spans {SPANS}")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns of batches as lists, a thousand rows at a time."""
    for b in batches:
        for at in range(0, len(b), 1000):
            yield [c.to_pylist() for c in b.slice(at, 1000).columns]


def _halved_groups(stages: Stages, contexts: DataFrame, length: int, gram: int, hot: int) -> DataFrame:
    """The same for contexts of hot anchors, whose groups are split until a task can hold them.

    A cell is a range of starts. All its windows share its core, so a window repeats only among contexts of one core;
    contexts that are equal over all windows of a cell repeat there, and one of them goes on for all. Groups of one core
    are sorted once they have at most ``hot`` members; larger ones are told apart by the longer cores of half the cell.
    A cell of one start has one kind of context to a core, so this ends after log2(length) rounds at the latest."""
    held = stages.keep(contexts.select("anchor", "ctx", "left", "multi", "bytes"))
    digest = xxhash.xxh3_128_digest
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.bool_()]
    names = ["anchor", "ctx", "lo", "hi", "first", "last", "core", "hull", "multi"]

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _slices(batches):
            rows = []
            for anchor, ctx, left, data, lo, hi, multi in zip(*columns):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    first, last = max(x, -left), min(y, len(data) - left - length)  # the starts that the context has
                    if first <= last:
                        core, hull = data[left + y:left + x + length], data[left + first:left + last + length]
                        rows.append((anchor, ctx, x, y, first, last, digest(core), digest(hull), multi))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    schema = "anchor bigint, ctx bigint, lo int, hi int, first int, last int, core binary, hull binary, multi boolean"
    cell, same = ["anchor", "lo", "hi", "core"], ["anchor", "lo", "hi", "core", "first", "last", "hull"]
    spans, small = [], []
    going = held.select("anchor", "ctx", "left", "bytes", F.lit(gram - length).alias("lo"), F.lit(0).alias("hi"), "multi")
    while True:
        rows = stages.keep(going.mapInArrow(halves, schema))
        alike = stages.keep(rows.groupBy(same).agg(F.min("ctx").alias("ctx"), F.max("ctx").alias("other"), F.max("multi").alias("multi")).withColumn(
            "settled", F.expr("multi or ctx != other")
        ))
        spans.append(rows.join(alike.filter("ctx != other").select(same), same).select(
            "anchor", "ctx", F.array(F.struct(F.col("first").alias("lo"), F.col("last").alias("hi"))).alias("spans")
        ))
        groups = alike.groupBy(cell).agg(F.count("*").alias("n"), F.min("settled").alias("done")).filter("n > 1 and not done")
        open_ = stages.keep(alike.join(groups, cell).select("anchor", "ctx", "lo", "hi", F.col("settled").alias("multi"), F.xxhash64(*cell).alias("group"), (F.col("n") > hot).alias("hot")))
        small.append(open_.filter("not hot").select("anchor", "ctx", "multi", "group"))
        large = open_.filter("hot").select("anchor", "ctx", "lo", "hi", "multi")
        if large.isEmpty():
            break
        going = held.drop("multi").join(large, ["anchor", "ctx"]).select("anchor", "ctx", "left", "bytes", "lo", "hi", "multi")
    whole = held.drop("multi").join(reduce(DataFrame.union, small), ["anchor", "ctx"])
    return reduce(DataFrame.union, spans).union(_sorted_groups(whole, length, gram))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, words: int | None = None) -> DataFrame:
    """(doc_id, digest, whole, spans) for documents that lose bytes: all windows that they have, or the windows that start
    at places lo to hi. With ``words`` a window is so many words and a place is one in the codes of the words."""
    stages = Stages(docs.sparkSession)
    code, least = (word_codes, 2 * words - 1) if words else (bytes, length)  # least: the fewest bytes of a window
    length = CODE_BYTES * words if words else length
    gram = min(GRAM, length)
    texts = _texts(docs, id_col, text_col)
    found = stages.keep(_anchor_rows(texts.filter(F.octet_length("text") >= least), length, gram, code))
    place = F.struct("digest", "pos")
    kinds = found.groupBy("anchor", "ctx").agg(
        F.min(place).alias("place"), (F.min(place) != F.max(place)).alias("multi"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    kinds, kinds_path = stages.write(kinds)
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("multi").alias("all_multi"), F.max("multi").alias("any_multi"))
    groups = groups.filter("n > 1 or any_multi")
    kinds = stages.keep(kinds.join(groups, "anchor").select(
        "anchor", "ctx", "place", "multi", "left", "right", ((F.col("n") > 1) & ~F.col("all_multi")).alias("open"), (F.col("n") > hot).alias("hot")
    ))
    stages.drop(kinds_path)
    settled = kinds.filter("multi").select(
        "anchor", "ctx",
        F.array(F.struct((-F.least("left", F.lit(length - gram))).cast("int").alias("lo"), F.least(F.lit(0), F.col("right") - length).cast("int").alias("hi"))).alias("spans"),
    )
    copies = stages.keep(texts.select("doc_id", "digest", F.octet_length("text").alias("n_bytes")).groupBy("doc_id", "digest", "n_bytes").agg(F.count("*").alias("rows")))
    by_text = copies.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.sum("rows").alias("rows"))

    def contexts(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("place.digest").agg(
            F.collect_list(F.struct("anchor", "ctx", F.col("place.pos").alias("pos"), "left", "right", "multi")).alias("wanted")
        ).join(by_text.select("digest", "rep"), "digest").select(F.col("digest").alias("d"), "rep", "wanted")
        return _context_rows(texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]) & (texts["digest"] == wanted["d"])), code)

    spans = settled.union(_sorted_groups(contexts(kinds.filter("open and not hot")), length, gram))
    many = kinds.filter("open and hot")
    if not many.isEmpty():
        spans = spans.union(_halved_groups(stages, contexts(many), length, gram, hot))
    spans = stages.keep(spans)
    release(docs.sparkSession)
    starts = found.join(spans, ["anchor", "ctx"]).select("digest", F.explode(F.transform("spans", lambda s: F.struct(
        (F.col("pos") + s["lo"]).alias("lo"), (F.col("pos") + s["hi"]).alias("hi")
    ))).alias("span")).groupBy("digest").agg(F.collect_set("span").alias("spans"))
    every = by_text.filter("rows > 1").select("digest", F.lit(True).alias("twice"))
    decided, path = stages.write(copies.join(every, "digest", "left").join(starts, "digest", "left").select(
        "doc_id", "digest", (F.coalesce("twice", F.lit(False)) & (F.col("n_bytes") >= least)).alias("whole"), "spans"
    ).filter("whole or spans is not null").withColumn("spans", F.when(~F.col("whole"), F.col("spans"))))
    stages.drop_all_but(path)
    release(docs.sparkSession)
    return decided


def _passages(data: bytes, whole: bool | None, spans, words: int) -> list[tuple[int, int]]:
    """The runs (start, end) of bytes under repeated windows of words."""
    place = [m.span() for m in WORD.finditer(data)]
    if whole:
        return [(place[0][0], place[-1][1])] if len(place) >= words else []
    runs = ((-(-s["lo"] // CODE_BYTES), s["hi"] // CODE_BYTES) for s in spans or [])  # the starts at a word
    return [(place[lo][0], place[hi + words - 1][1]) for lo, hi in runs if lo <= hi]


def _kept(data: bytes, found: dict, length: int, words: int | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the removed runs (start, end)."""
    if found["whole"]:
        return b"", [(0, len(data))]
    under = [(s["lo"], s["hi"] + length) for s in found["spans"] or []]
    if words and (found["whole_words"] or found["word_spans"]):
        under += _passages(data, found["whole_words"], found["word_spans"], words)
    runs: list[list[int]] = []
    for lo, hi in sorted(under):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), [tuple(r) for r in runs]


def _with_removals(docs: DataFrame, id_col: str, text_col: str, length: int, hot: int, words: int | None) -> tuple[DataFrame, list[str]]:
    """``docs`` with the bytes of the text and what ``_kept`` needs (null where nothing goes), and the names of both."""
    names = free_names(docs, "bytes", "found", "own", "id", "digest")
    data, found, own, id_, digest = names
    gone = removals(docs, id_col, text_col, length, hot)
    if words:
        by_words = removals(docs, id_col, text_col, hot=hot, words=words).withColumnsRenamed({"whole": "whole_words", "spans": "word_spans"})
        gone = gone.unionByName(by_words, allowMissingColumns=True).groupBy("doc_id", "digest").agg(
            *(F.first(c, ignorenulls=True).alias(c) for c in ("whole", "spans", "whole_words", "word_spans"))
        )
    gone = gone.select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.struct(*gone.columns[2:]).alias(found))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.withColumn(data, text).withColumn(own, F.unhex(F.md5(data)))
    joined = rows.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(own) == F.col(digest)), "left")
    return joined.select(*docs.columns, data, found), names[:2]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, words: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, removed) for every row; removed: (start, end) of the maximal runs."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows, found = _with_removals(plain, "doc_id", "text", length, hot, words)
    rows = rows.select("doc_id", *found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            out = [_kept(t.as_py(), f.as_py(), length, words) if f.is_valid else (t.as_py(), []) for t, f in zip(b.column(1), b.column(2))]
            sizes = np.array([len(t.as_py()) for t in b.column(1)], np.int64)
            left = np.array([len(k) for k, _ in out], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes), pa.array(sizes - left), pa.array([k for k, _ in out], pa.binary()),
                 pa.array([[{"start": x, "end": y} for x, y in runs] for _, runs in out], pair)],
                ["doc_id", "n_bytes", "n_removed", "kept", "removed"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, kept binary, removed array<struct<start:bigint,end:bigint>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", length: int = LENGTH, hot: int = HOT, words: int | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, their texts without the repeated bytes (characters cut apart go as well) and
    ``chars_col`` counted again where a text changed."""
    rows, _ = _with_removals(docs, id_col, text_col, length, hot, words)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(columns.index(text_col)).to_pylist()
            chars = b.column(columns.index(chars_col)).to_pylist() if chars_col in columns else None
            for k, (t, f) in enumerate(zip(b.column(len(columns)), b.column(len(columns) + 1))):
                if f.is_valid:
                    left, runs = _kept(t.as_py(), f.as_py(), length, words)
                    if not runs:
                        continue
                    texts[k] = left.decode("utf-8", "ignore")
                    if chars:
                        chars[k] = len(texts[k])
            arrays = [b.column(i) for i in range(len(columns))]
            arrays[columns.index(text_col)] = pa.array(texts, b.schema.field(text_col).type)
            if chars:
                arrays[columns.index(chars_col)] = pa.array(chars, b.schema.field(chars_col).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return rows.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
