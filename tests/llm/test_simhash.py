"""SimHash near-duplicates against a brute-force version, and the edge cases of the docstring."""

import hashlib
import itertools
import random
import re

import numpy as np
import xxhash

from fluxwarden.llm import simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(ids, fps):
    root = dict(zip(ids, ids))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(zip(ids, fps), 2):
        if (a ^ b).bit_count() <= 3:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_query_is_brute_force(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    fps = [plain(t) for _, t in rows]
    comp = components([i for i, _ in rows], fps)
    assert got == {i: (f"{f:016x}", comp[i]) for (i, _), f in zip(rows, fps)}


def test_all_links_of_planted_fingerprints(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.append(base)
        for _ in range(6):  # chains and stars with one to four flipped bits
            near = rng.choice(fps[-3:])
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
                near ^= 1 << b
            fps.append(near)
    fps = sorted(set(fps))
    links = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp bigint")
    found = simhash.bucket_links(simhash.bucket_rows(links)).collect()
    to = {int(np.uint64(f).view(np.int64)): k for k, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        assert (fps[to[a]] ^ fps[to[b]]).bit_count() <= 3
        x, y = sorted((find(to[a]), find(to[b])))
        root[y] = x
    assert {k: find(k) for k in range(len(fps))} == components(list(range(len(fps))), fps)


def test_dense_bucket_and_long_text():
    fps = np.array([[sum(1 << b for b in c)] for c in itertools.combinations(range(20), 2)], np.uint64)
    assert len(simhash.spanning_links(fps, 3)) == len(fps) - 1
    words = " ".join(f"w{i % 977}" for i in range(300_000))
    whole = simhash.fingerprint(words.encode())
    block, simhash.BLOCK_BYTES = simhash.BLOCK_BYTES, 1000
    try:
        assert (simhash.fingerprint(words.encode()) == whole).all()
    finally:
        simhash.BLOCK_BYTES = block


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Ab cD", None), (3, "ab\tcd", "y"), (None, "ab cd", "z"), (4, "é", "z")]
    done = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fp string")).collect()
    got = sorted(((r.doc_id or 0), r.fp == 0, r.component_id) for r in done)
    assert got == [(0, False, 3), (1, True, 1), (2, True, 1), (3, False, 3), (3, False, 3), (4, False, 4)]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_one_of_each_by_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    rows = []
    for k in range(0, 900, 10):
        text = rng.choices(words, k=120)
        rows.append((k, " ".join(text)))
        if k % 30 == 0:
            text[rng.randrange(120)] = "other"
            rows.append((k + 1, " ".join(text)))
    rows += [(0, rows[0][1]), (None, "x"), (None, "x"), (5000, None), (5001, "")]
    rows += [(5, rows[4][1]), (5, rows[8][1]), (5, "quite another text of its own"), (2, "b one text"), (6, "b one text"), (2, "a second text of the same id")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id bigint, text string, fp int, digest int")
    kept = simhash.keep_one_of_each(frame)
    assert kept.columns == frame.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    named = sorted({(i, t or "") for i, t in rows if i is not None}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).digest()))
    fps = {r: int(simhash.fingerprint(r[1].encode())[0]) for r in named}
    expected, reached = [], set()
    for r in named:
        if r in reached:
            continue
        expected.append(r)
        todo = [r]
        while todo:
            x = todo.pop()
            near = [y for y in named if y not in reached and (fps[x] ^ fps[y]).bit_count() <= 3]
            reached.update(near)
            todo += near
    assert sorted((i, t or "") for i, t in left if i is not None) == sorted(expected)
    assert [t for i, t in left if i is None] == ["x", "x"]
    assert simhash.keep_one_of_each(frame.filter("doc_id > 9999")).count() == 0
