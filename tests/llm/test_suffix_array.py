"""Repeated strings against a byte-wise count of all windows, and the edge cases of the docstring."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from fluxwarden.llm import suffix_array

SF = "/root/testdata/sf0.001"


def plain(texts, length):
    """(n_bytes, n_removed, n_spans, sha) by counting every window of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(hash(d[i:i + length]) for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = np.zeros(len(d) + 1, int)
        for i in range(len(d) - length + 1):
            if seen[hash(d[i:i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        mask = np.cumsum(gone)[:-1] > 0
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(d) else 0
        yield len(d), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, m in zip(d, mask) if not m)).hexdigest()


def ours(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in df.collect())


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in suffix_array.query(spark, SF).collect())
    assert got == sorted((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows], 400)))
    assert sum(r[2] for r in got)


@pytest.mark.parametrize("length,hot", [(40, 4000), (40, 1), (64, 3), (20, 4000)])
def test_shared_passages(spark, length, hot):
    rng = random.Random(length + hot)
    word = lambda n: "".join(rng.choices("abcdé ", k=n))
    passages = [word(rng.randint(length // 2, 3 * length)) for _ in range(6)] + ["ab" * length, "z" * (2 * length)]
    texts = []
    for _ in range(80):
        t = "".join(rng.choice([word(rng.randint(0, 2 * length)), rng.choice(passages)[rng.randint(0, 3):]]) for _ in range(rng.randint(0, 6)))
        texts.append(t)
        if rng.random() < 0.2:
            near = list(t)
            if near:
                near[rng.randrange(len(near))] = "x"
            texts.append("".join(near))
    texts += [texts[0], texts[0], passages[0][:length], passages[1][:length - 1]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert ours(suffix_array.dedup(frame, length=length, hot=hot)) == sorted((k, *x) for k, x in enumerate(plain(texts, length)))


def test_sort_and_extensions():
    rng = random.Random(9)
    pieces = ["".join(rng.choices("ab", k=rng.randint(6, 30))).encode() for _ in range(200)]
    pieces += pieces[:20]
    group = np.sort(np.array([rng.randrange(9) for _ in pieces]))
    left = np.array([rng.randint(0, len(p)) for p in pieces])
    c = suffix_array.Contexts(group, left, pieces, 5)
    for forward in (True, False):
        order, shared = c.order(forward)
        side = [p[x:] if forward else p[:x][::-1] for p, x in zip(pieces, left)]
        assert [(group[k], side[k]) for k in order] == sorted((group[k], side[k]) for k in range(len(pieces)))
        for k in range(1, len(order)):
            a, b = side[order[k - 1]], side[order[k]]
            n = 0
            while group[order[k]] == group[order[k - 1]] and n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert shared[k] == n
        least = suffix_array.RangeMinimum(shared)
        a, b = np.array([0, 3, 50, 219]), np.array([1, 90, 49, 0])
        assert least.between(a, b).tolist() == [min(shared[min(x, y) + 1:max(x, y) + 1]) for x, y in zip(a, b)]


def test_blocks_do_not_matter():
    data = bytes(random.Random(3).choices(range(97, 100), k=30_000))
    whole = suffix_array.anchors(data, 100, 32)
    block, suffix_array.BLOCK_BYTES = suffix_array.BLOCK_BYTES, 700
    try:
        again = suffix_array.anchors(data, 100, 32)
    finally:
        suffix_array.BLOCK_BYTES = block
    assert all((a == b).all() for a, b in zip(whole, again))


def test_edges(spark):
    same, long = "passage " * 60, "é" * 90_000
    rows = [(1, None, 0), (2, "", 0), (None, same, 0), (None, same, 0), (4, same[:399], 0), (5, "x" + same[:400], 0), (6, long, 0), (7, "tiny", 0), (7, "tiny", 0)]
    frame = spark.createDataFrame([(i, t, len(t or ""), "z") for i, t, _ in rows], "doc_id bigint, text string, n_chars bigint, _text string")
    expected = sorted(((i if i is not None else -1), *x) for (i, _, _), x in zip(rows, plain([r[1] for r in rows], 400)))
    assert ours(suffix_array.dedup(frame)) == expected
    for name in ("_own", "_id", "_spans", "_bytes"):  # columns of any name
        assert suffix_array.remove_repeats(frame.withColumnRenamed("_text", name)).columns[-1] == name
    kept = suffix_array.remove_repeats(frame)
    assert kept.columns == frame.columns
    assert {(r.doc_id, r.text) for r in kept.collect()} >= {(1, None), (2, ""), (None, ""), (4, same[:399]), (7, "tiny")}
    assert kept.count() == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in kept.collect())
    assert suffix_array.dedup(frame.limit(0)).count() == 0


def test_hot_anchors_make_few_rows(spark, monkeypatch):
    """A passage in many texts: no table has more than some rows for each anchor, whatever the windows at its edges."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = word(900)
    texts = [word(500) + passage + word(500) for _ in range(200)] + [passage]
    counts, keep = [], suffix_array.Stages.keep

    def counted(self, df):
        kept = keep(self, df)
        counts.append(kept.count())
        return kept

    monkeypatch.setattr(suffix_array.Stages, "keep", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert ours(suffix_array.dedup(frame, hot=20)) == sorted((k, *x) for k, x in enumerate(plain(texts, 400)))
    assert max(counts) <= 2 * counts[0]  # the first table holds the anchors


def plain_words(texts, length, words):
    """What ``plain`` returns, by counting every window of bytes and every window of words of every text."""
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", d)] for d in data]
    windows = [[tuple(d.split()[i:i + words]) for i in range(len(p) - words + 1)] for d, p in zip(data, places)]
    seen = Counter(w for x in windows for w in x)
    strings = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    for d, place, found in zip(data, places, windows):
        mask = np.zeros(len(d), bool)
        for i, w in enumerate(found):
            if seen[w] > 1:
                mask[place[i][0]:place[i + words - 1][1]] = True
        for i in range(len(d) - length + 1):
            if strings[d[i:i + length]] > 1:
                mask[i:i + length] = True
        spans = int(mask[:1].sum()) + int((mask[1:] & ~mask[:-1]).sum())
        yield len(d), int(mask.sum()), spans, hashlib.sha256(bytes(b for b, m in zip(d, mask) if not m)).hexdigest()


@pytest.mark.parametrize("length,words,hot", [(40, 5, 4000), (400, 6, 4000), (30, 12, 1), (400, 20, 3)])
def test_passages_of_words(spark, length, words, hot):
    rng = random.Random(words)
    vocabulary = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(200)] + ["a", "b"]
    some = lambda n: "".join(w + rng.choice([" ", " ", "\n", "  \t"]) for w in rng.choices(vocabulary, k=n))
    passages = [some(rng.randint(words - 2, 3 * words)) for _ in range(6)] + ["a " * (2 * words), "a b " * words]
    texts = ["".join(rng.choice([some(rng.randint(0, 2 * words)), rng.choice(passages)]) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    texts += [texts[0], " ".join(texts[1].split()), " " + passages[0], passages[0] + " ", passages[0], passages[0], "a", "a", None, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    expected = sorted((k, *x) for k, x in enumerate(plain_words(texts, length, words)))
    assert ours(suffix_array.dedup(frame, length=length, hot=hot, words=words)) == expected
    kept = {r.doc_id: r.text for r in suffix_array.remove_repeats(frame, length=length, hot=hot, words=words).collect()}
    assert {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in kept.items()} == {k: x for k, _, _, _, x in expected}


def test_passage_below_400_bytes(spark):
    """Over 50 words in under 400 bytes, in two texts: no string of 400 bytes repeats, the passage of words does."""
    passage = " ".join(f"word{k}" for k in range(55))
    texts = [f"here begins {passage} and goes on", f"another {passage}\nends", "no passage"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert len(passage) < 400
    assert sorted(r.text for r in suffix_array.remove_repeats(frame).collect()) == sorted(texts)
    assert sorted(r.text for r in suffix_array.remove_repeats(frame, words=50).collect()) == ["another \nends", "here begins  and goes on", "no passage"]
    assert sorted(r.text for r in suffix_array.remove_repeats(frame, words=56).collect()) == sorted(texts)
