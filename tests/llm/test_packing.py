"""Packing against whole-text tokenization, the rules of the layout, and the edge cases of the docstring."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fluxwarden.llm import packing

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def plain_pieces(rows):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    for id_, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            cut = np.array(ids[k:k + 4096], "<u4").tobytes()
            yield id_, k // 4096, k, len(cut) // 4, zlib.crc32(cut)


def check_layout(rows, capacity=4096):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_query_matches_whole_texts(spark):
    rows = packing.query(spark, SF).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(plain_pieces(docs))
    tokens = sum(r.length for r in rows)
    assert check_layout(rows) <= -(-tokens // 4096) + 1


def test_words_have_the_ids_of_the_text():
    text = "Don't  stop <|endoftext|>x<|startoftext|> ́aẛ̣ 　ΑΣ ΣΑΣ\x1cA\x85b 12345 !!?  naïve 👩‍👩‍👧 it'S\n\tend<|endoftext|"
    encoder = packing.WordEncoder(VOCABULARY)
    whole = Tokenizer.from_file(VOCABULARY).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(b"".join(encoder.blocks(text.encode())), "<u4").tolist() == whole


def test_control_characters_before_punctuation():
    encoder, tokenizer = packing.WordEncoder.of_process(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in ("\x00'", "a\x01!", "\x7f..", "x\x00'S", "_'", "\x02"):
        assert np.frombuffer(b"".join(encoder.blocks(text.encode())), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_random_words_have_their_ids():
    tokenizer, encoder, rng = Tokenizer.from_file(VOCABULARY), packing.WordEncoder.of_process(VOCABULARY), random.Random(1)
    signs = list("aB'éÉ\u0301İǰJ\u030cK1½!.,…<|>startoftext \n\u3000\xa00’sßΣ가각ี-") + ["<|endoftext|>", "'S", "\x00", "\x01", "\x7f", "\x1f"]
    for _ in range(8000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 12)))
        got = np.frombuffer(b"".join(encoder.blocks(text.encode())), "<u4").tolist()
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    top = [4096, 4096, 1365, 2047, 300, 3000][seed]
    histogram = Counter(rng.randint(1, top) for _ in range(5000))
    histogram[rng.randint(1, top)] += 4000
    slots = packing.plan_sequences(dict(histogram))
    used, placed = Counter(), Counter()
    for n, first, end, sequence, copies, offset in slots:
        placed[n] += end - first
        for r in range(first, end):
            s = sequence + (r - first) // copies
            assert offset + ((r - first) % copies + 1) * n <= 4096
            used[s] += n
    assert placed == histogram
    assert max(used.values()) <= 4096
    rooms = []  # best fit of single pieces in falling size
    for n in sorted(histogram.elements(), reverse=True):
        at = bisect.bisect_left(rooms, n)
        bisect.insort(rooms, (rooms.pop(at) if at < len(rooms) else 4096) - n)
    assert len(used) <= len(rooms) * 1.002 + 1


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y", "c"), (2, "", "b"), (5, "word " * 9000, "d"), (5, "word " * 9000, "d"), (6, "x" * 50_000, "e")]
    done = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string, length string"), VOCABULARY).collect()
    assert sorted((tuple(r)[:5] for r in done), key=str) == sorted(plain_pieces([r[:2] for r in rows]), key=str)
    check_layout(done)
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, text string"), VOCABULARY).count() == 0
