"""Spelling variants against deletion keys and plain loops, and the edge cases of the docstring."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluxwarden.llm import spelling

SF = "/root/testdata/sf0.01"


def plain_counts(rows, least=3):
    runs, counts = re.compile("[A-Za-zÀ-ÿ]+"), Counter()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for i, text in rows:
        for w in runs.findall(text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{i if i is not None else 'null'}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= least}


def plain_near(words):
    """word -> near words, by the words with one letter left out."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[k, w[:k] + w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in words:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def plain(counts):
    near, forms = plain_near(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, len(near[w]), counts[forms[w]] if forms[w] else None))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_is_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    expected = plain(plain_counts(docs))
    assert sum(1 for r in expected if r[1]) > 100
    assert rows_of(spelling.query(spark, SF)) == expected


@pytest.mark.parametrize("leaf_words,sample_words", [(20, 1000), (50, 60), (10**6, 1)])
def test_many_leaves(spark, leaf_words, sample_words):
    rng = random.Random(4)
    counts = {}
    for _ in range(1500):
        w = "".join(rng.choices("abé", k=rng.choice([5, 6, 7, 8])))
        counts[w] = rng.randrange(3, 400)
    frame = spark.createDataFrame(sorted(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(frame, sample_words, leaf_words)) == plain(counts)


def test_edges(spark):
    long = "ab" * 4_000
    counts = {long: 9, long + "a": 3, "x" * 5: 4, "x" * 6: 8, "x" * 7: 16, "x" * 8: 32, "x" * 9: 63, "ß漢字かな": 5, "ß漢字かた": 10, "ßß漢字かな": 5}
    frame = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert rows_of(spelling.variants(frame)) == plain(counts)
    assert spelling.variants(frame.filter("n > 99")).count() == 0


def test_counting(spark):
    rng = random.Random(1)
    words = ["Apple", "apple", "ÀÉÎõü", "àéîõü", "ab", "house", "houses", "a×b÷c", "naïveté"]
    rows = [(k % 50 if k % 7 else None, " ".join(rng.choices(words, k=40)) if k % 11 else None, "x") for k in range(400)]
    rows += [(1, "", "x"), (2, "x" * 20 + "\x00" + "y" * 20, "x"), (3, "Apple,appleĀapple漢apple" * 3, "x")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, word string")
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == plain_counts([r[:2] for r in rows])
    assert spelling.count_words(frame.filter("doc_id > 99")).count() == 0


def test_counting_in_blocks(spark, monkeypatch):
    text = " ".join(f"word{chr(97 + k % 26)}é" for k in range(3000))
    frame = spark.createDataFrame([(5, text)], "doc_id bigint, text string")
    expected = plain_counts([(5, text)])
    for name, size in (("BLOCK_BYTES", 50), ("FLUSH_WORDS", 3)):
        monkeypatch.setattr(spelling, name, size)
    assert {r.word: r.n for r in spelling.count_words(frame).collect()} == expected


def test_tree_reaches_what_one_edit_can_reach():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdef"), 7)) for _ in range(800)]
    points = spelling.letter_counts(spelling.letters(words, 7))
    tree = spelling.Tree(points, 10)
    home = tree.home(points)
    assert len(tree.leaves) > 30 and all((home[rows] == k).all() for k, rows in enumerate(tree.leaves))
    reached = {(int(r), k) for rows, k in tree.visit(points, 1, 1) for r in rows}
    apart = np.abs(points[:, None] - points[None]).sum(axis=2)
    for i, j in np.argwhere(apart <= 2):
        assert (i, home[j]) in reached
    assert len(reached) < 0.7 * len(words) * len(tree.leaves)  # boxes are pruned
