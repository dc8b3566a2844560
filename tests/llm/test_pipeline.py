"""Each stage of the pipeline against a brute-force version on its own input."""

import pytest

import corpus_pipeline
from fluxwarden.llm import simhash
from fluxwarden.llm.common import Stages

from .test_packing import check_layout, plain_pieces
from .test_suffix_array import plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Rows after each stage, the documents first."""
    stages, docs, found = Stages(spark), spark.read.parquet(f"{SF}/documents.parquet"), []
    found.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        docs = stages.keep(stage(spark, docs, SF))
        found.append(docs)
    return found


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_array", "mixing", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:5])


def test_toxicity_keeps_clean_documents(spark, steps):
    before, after = by_id(steps[0]), by_id(steps[1])
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(after[i] == before[i] for i in after)
    assert not [i for i in before if labels.get(i) == 0 and i not in after]


def test_near_copies_by_brute_force(steps):
    before, after = by_id(steps[1]), by_id(steps[2])
    fps = {i: int(simhash.fingerprint(r.text.encode())[0]) for i, r in before.items()}
    expected, reached = set(), set()
    for i in sorted(before):  # the least id of each component
        if i in reached:
            continue
        expected.add(i)
        todo = [i]
        while todo:
            x = todo.pop()
            near = {j for j in fps if j not in reached and (fps[x] ^ fps[j]).bit_count() <= 3}
            reached |= near
            todo += near
    assert set(after) == expected and all(after[i] == before[i] for i in after)


def test_repeats_by_brute_force(steps):
    before, after = by_id(steps[2]), by_id(steps[3])
    assert set(before) == set(after)
    ids = sorted(before)
    for i, (n_bytes, removed, _, _) in zip(ids, plain([before[i].text for i in ids], 400)):
        assert after[i].text == before[i].text if not removed else len(after[i].text.encode()) <= n_bytes - removed
        assert after[i].n_chars == len(after[i].text)


def test_passages_of_over_50_words(spark):
    """The stage removes them from all documents that have them, below 400 bytes too, and leaves 50 words alone."""
    passage = " ".join(f"word{k}" for k in range(51))
    shorter = " ".join(f"other{k}" for k in range(50))
    texts = [f"here begins {passage} and goes on", f"another {passage}\nends", f"a {shorter} z", f"b {shorter} y", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert len(passage) < 400 and len(shorter) < 396
    after = by_id(corpus_pipeline.drop_repeats(spark, frame, SF))
    assert [after[k].text for k in range(5)] == ["here begins  and goes on", "another \nends", *texts[2:]]
    assert [after[k].n_chars for k in range(5)] == [24, 13, len(texts[2]), len(texts[3]), 0]


def test_mixing_keeps_every_document(steps):
    before, rows = by_id(steps[3]), steps[4].collect()
    assert {r.doc_id for r in rows} == set(before)
    assert all(r == before[r.doc_id] for r in rows)


def test_packing_by_brute_force(steps):
    rows = steps[5].collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(plain_pieces([(r.doc_id, r.text) for r in steps[4].collect()]))
    check_layout(rows)


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() == steps[5].count()
