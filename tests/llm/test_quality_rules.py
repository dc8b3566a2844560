"""The quality rules against a plain Python count, and the edge cases of the docstring."""

import re
from collections import Counter

import pytest

from fluxwarden.llm import quality_rules as rules

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    n = len(words)
    return (
        n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        n < 50 or 100 * len(covered) > 50 * n,
    )


def counts(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_query_is_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    done = rules.query(spark, SF).collect()
    assert {r.doc_id: counts(r) for r in done} == {i: plain(t) for i, t in texts.items()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in done if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in done if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_edges(spark):
    long = "the one of a kind and " * 40_000
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \n\t\r\x0b\x0c ", "x"), (4, "one", "x"), (5, "a b c a b c", "x"), (6, "a b c b c", "x"),
        (7, "x x x x", "x"), (8, "x x x", "x"), (9, "#*$%&|<>\n#*$%&|<>\n\n \n", "x"), (10, long, "x"), (11, "é è   \x00\x1f a\x85b", "x"),
        (12, "one", "x"), (12, "one", "x"), (None, "ab ab", "x"), (13, "l\r\nl\nl\r\n l", "x"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, words string")
    done = rules.judge(frame).collect()
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, *counts(r)) for r in done), key=key) == sorted(((i, *plain(t)) for i, t, _ in rows), key=key)
    assert rules.judge(frame.filter("doc_id > 99")).count() == 0


def test_rules_and_kept_rows(spark):
    # thirty different stop words and forty-five others, no window twice
    good = " ".join(f"{w} word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k, w in enumerate(rules.STOP_WORDS[:30] * 2)) + "."
    rows = {
        "good": good, "symbols": good.replace(" word", " |# word"), "capitals": good.upper(), "letters": good.replace(" word", " 0123456"),
        "word_length": good.replace("word", "w" * 40), "stop_words": re.sub(r"(^| )\S+ word", r"\1other word", good), "short": "a few words",
    }
    frame = spark.createDataFrame([(k, t, 1, 2) for k, t in rows.items()], "doc_id string, text string, kept int, row int")
    failed = {r.doc_id: r.failed for r in rules.judge(frame).collect()}
    assert failed["good"] == []
    for name in ("symbols", "capitals", "letters", "word_length", "stop_words"):
        assert name in failed[name], (name, failed[name])
    kept = rules.keep_good(frame)
    assert kept.columns == frame.columns
    assert [tuple(r) for r in kept.collect()] == [("good", good, 1, 2)]
    everything = rules.keep_good(frame, rules=())
    assert everything.count() == 6


@pytest.mark.parametrize("table", [(("none", "n_words", None, None),), ()])
def test_tables_without_bounds(spark, table):
    frame = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    assert rules.judge(frame, rules=table).first().failed == []


def test_no_user_functions(spark):
    plan = rules.query(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
