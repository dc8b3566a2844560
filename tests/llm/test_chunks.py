"""Chunking against a byte-wise loop, the query against plain Python, and the edge cases of the docstring."""

import hashlib
import random

import pytest

from fluxwarden.llm import chunks

SF = "/root/testdata/sf0.001"


def plain_cuts(data):
    start, h = 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(chunks.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        bits = chunks.STRICT if size < chunks.NORMAL or size == chunks.NORMAL and h >> 26 == 0 else chunks.LOOSE
        if size >= chunks.MIN and h >> (32 - bits) == 0 or size == chunks.MAX or i + 1 == len(data):
            yield start, i + 1
            start = i + 1


def test_cuts_are_those_of_a_running_hash():
    rng = random.Random(2)
    for n in (0, 1, 15, 16, 40, 41, 160, 161, 5000, 70_000):
        for alphabet in (b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            whole = list(chunks.cuts(data))
            assert whole == list(plain_cuts(data))
            block, chunks.BLOCK_BYTES = chunks.BLOCK_BYTES, 500
            try:
                assert list(chunks.cuts(data)) == whole
            finally:
                chunks.BLOCK_BYTES = block


def test_likeness_follows_edits():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)).encode()
    other = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)).encode()
    a = chunks.tokens(text)
    assert chunks.likeness(a, chunks.tokens(text)) == 1
    assert chunks.likeness(a, chunks.tokens(b"xyz" + text[:7000] + b"new words" + text[7000:])) > 0.95
    assert 0.4 < chunks.likeness(a, chunks.tokens(text[:7000] + other[:7000])) < 0.6
    assert chunks.likeness(a, chunks.tokens(other)) < 0.05
    assert chunks.likeness(a, chunks.tokens(text[3000:8000])) > 0.9  # containment


def expect(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = (t[:len(t) - half] + following[:half]).encode()
        a, b = chunks.tokens(t.encode()), chunks.tokens(edited)
        yield i, len(t), hashlib.sha256(edited).hexdigest(), chunks.as_hex(a), chunks.as_hex(b), chunks.likeness(a, b), chunks.likeness(a, chunks.tokens(following.encode()))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = chunks.query(spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(expect([tuple(r) for r in docs]))


@pytest.mark.parametrize("rows", [
    [],
    [(7, "alone " * 40)],
    [(1, None), (2, ""), (5, "é" * 301), (5, "b" * 80), (5, "b" * 80), (9, "x y z " * 900), (None, "null id " * 30), (None, None), (12, "w")],
])
def test_edges(spark, rows):
    frame = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, bucket string")
    got = sorted((tuple(r) for r in chunks.compare_with_next(frame).collect()), key=str)
    assert got == sorted(expect(rows), key=str)
    assert sorted(tuple(r)[0:3:2] for r in chunks.fingerprints(frame).collect() if r.doc_id) == sorted((r[0], r[3]) for r in got if r[0])
