"""Chat formatting against plain Python, read back from the output, and its edge cases."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from fluxwarden.llm import chat

SF = "/root/testdata/sf0.01"


def plain(rows):
    """conv -> (n_turns, turns_sha256, loss_chars, loss_sha256), rows (conv, turn, role, text)."""
    key = lambda r: (r[1] is not None, r[1] if r[1] is not None else 0, r[2] or "", r[3] or "")
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), key(r))), key=lambda r: r[0]):
        turns = [(r[2] or "", r[3] or "") for r in group]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def ours(df):
    """The same, read back from the formatted texts."""
    lines = F.transform(chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    rows = df.select("conv_id", F.size(lines).alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("whole"), loss.alias("loss")).collect()
    return {r.conv_id: (r.n, r.whole, len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest()) for r in rows}


def test_query_is_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", chat.EXTRA), (-7, 1, "assistant", chat.EXTRA)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.query(spark, SF).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("block_turns", [2, 256])
def test_edges(spark, block_turns):
    signs = ["<turn>", "</turn>", "<say>", "<and>", "\\", "\\s", "\\o", "\\\\c", "", "é\n", "### Assistant: "]
    rows = [(1, k, ["user", "assistant"][k // 3 % 2], a + b) for k, (a, b) in enumerate(itertools.product(signs, signs))]
    rows += [(2, 0, None, None), (2, 1, None, "x"), (2, 2, "assistant", None), (3, 0, "assistant", "only"), (4, 5, "user", "late"), (4, -3, "user", "early")]
    rows += [(5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (5, 1, "user", "tie"), (6, 0, "<turn>\\", "role"), (7, 0, "assistant", "long " * 50_000)]
    rows += [(None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(8, 0, "assistant", f"one turn number {k}") for k in range(600)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, block string")
    done = chat.format_conversations(frame, block_turns=block_turns)
    assert ours(done) == plain(rows)
    parts = done.select("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("joined")).collect()
    assert all(r.formatted == r.joined for r in parts)
    assert chat.format_conversations(frame.filter("conv_id > 99")).count() == 0


def test_null_turns(spark):
    frame = spark.createDataFrame([(1, None, "user", "a"), (1, 0, "assistant", "b")], "conv_id long, turn long, role string, text string")
    assert ours(chat.format_conversations(frame)) == plain([tuple(r) for r in frame.collect()])
