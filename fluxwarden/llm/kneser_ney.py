"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters, one model per language.

Counts. The n-grams (``ORDER`` = 4 characters, packed 16 bits each into a long; digits are one character, characters
beyond 16 bits another) of all documents are counted where the rows lie, those of trusted documents apart, and summed
by Spark: (language, gram, count in trusted text). Lower orders are continuation counts of the next higher one.
Discounts come from the counts of counts of each order and language.

Model. Contexts' totals and back-off weights are aggregations of the counts; the probability of every gram that any
document has is a chain of joins, sharded by (language, gram) and (language, context), from the highest order down.

Scores. Documents are dealt to blocks of one language of ``block_bytes``, and the language's table of gram
probabilities is dealt to each of its blocks. A task reads the table of a block, then streams the block's documents;
memory is one table and one text. So the text moves twice (to its label, to its block), and no row per n-gram of a
document ever does.

Verdict. The mean of -log p is drawn towards the language's mean by ``SHRINK`` characters, so that short texts do not
fail by chance, and a document is kept up to ``SLACK`` times the ``quantile`` of the trusted documents of its
language; the slack is for texts that the model was not trained on.

Defined results: a null or empty text has no perplexity and is not kept; a null language is a language of its own;
a language without trusted documents keeps its documents; null ids and repeated rows are kept as rows (a null id is
never trusted); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluxwarden.llm.common import Stages, partitions, release

ORDER = 4
BLOCK_BYTES = 64 << 20
GRAMS_AT_ONCE = 1 << 21
SHRINK = 100
QUANTILE = 0.99
SLACK = 1.03
START = 2


def grams(text: str) -> np.ndarray:
    """The packed 4-grams that end at each character of a text; what stands before the text is ``START``."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    c[c > 0xFFFE] = 0xFFFF
    c[(c >= 48) & (c <= 57)] = 48
    c = np.concatenate([np.full(ORDER - 1, START, np.uint64), c])
    n = len(c) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = out << np.uint64(16) | c[k:k + n]
    return out.view(np.int64)


def _count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) from (lang, trusted, text): n is the count in trusted documents, 0 for a gram of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], list[np.ndarray]] = {}
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for (lang, trusted), parts in held.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]).take(pa.array(np.zeros(len(gram), np.int64))), pa.array(gram), pa.array(n * trusted)], ["lang", "gram", "n"]
                )
            held.clear()

        for b in batches:
            for lang, trusted, text in zip(*(b.column(i) for i in range(3))):
                found = grams(text.as_py())
                held.setdefault((lang.as_py(), trusted.as_py()), []).append(found)
                size += len(found)
                if size > GRAMS_AT_ONCE:
                    yield from emit()
                    size = 0
        yield from emit()

    rows = docs.select("lang", "trusted", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tail(gram: Column, k: int) -> Column:
    """The last k characters of a gram."""
    return gram.bitwiseAND(F.lit((1 << 16 * k) - 1)) if k < ORDER else gram


def _levels(stages: Stages, counts: DataFrame) -> dict[int, tuple[DataFrame, DataFrame]]:
    """For each order: (lang, gram, part) with the discounted share of seen grams, and (lang, ctx, weight) with the
    weight that a context leaves to the next lower order."""
    found, table = {}, counts.filter("n > 0")
    for k in range(ORDER, 0, -1):
        if k < ORDER:  # continuation counts: how many different characters stand in front
            table = table.groupBy("lang", _tail(F.col("gram"), k).alias("gram")).agg(F.count("*").alias("n"))
        table = stages.keep(table)
        seen = [F.sum((F.col("n") == j).cast("long")).alias(f"n{j}") for j in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        cut = table.groupBy("lang").agg(*seen)  # a row for each language
        # d(j) = j - (j + 1) * y * n(j + 1) / n(j), within [0, j]; half a count where a language has too few grams
        for j in (1, 2, 3):
            d = j - (j + 1) * y * F.col(f"n{j + 1}") / F.col(f"n{j}")
            cut = cut.withColumn(f"d{j}", F.when((F.col(f"n{j}") > 0) & (F.col("n1") > 0), F.greatest(F.lit(0.0), F.least(d, F.lit(float(j))))).otherwise(0.5))
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = table.join(cut.select("lang", "d1", "d2", "d3"), "lang").select(
            "lang", "gram", "n", discount.alias("d"), F.shiftrightunsigned("gram", 16).alias("ctx")
        )
        contexts = rows.groupBy("lang", "ctx").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        found[k] = (
            rows.join(contexts, ["lang", "ctx"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("part")),
            contexts.select("lang", "ctx", (F.col("left") / F.col("total")).alias("weight")),
        )
    return found


def gram_probabilities(stages: Stages, counts: DataFrame) -> DataFrame:
    """(lang, gram, logp) for every gram of ``counts``: the interpolated probability of its last character."""
    levels = _levels(stages, counts)
    symbols = counts.filter("n > 0").select("lang", _tail(F.col("gram"), 1).alias("c")).groupBy("lang").agg((F.countDistinct("c") + 1).alias("symbols"))
    rows = counts.select("lang", "gram")
    for k in range(ORDER, 0, -1):
        seen, contexts = levels[k]
        rows = rows.withColumn("_g", _tail(F.col("gram"), k)).withColumn("_c", F.shiftrightunsigned("_g", 16))
        rows = rows.join(seen.select("lang", F.col("gram").alias("_g"), F.col("part").alias(f"part{k}")), ["lang", "_g"], "left")
        rows = rows.join(contexts.select("lang", F.col("ctx").alias("_c"), F.col("weight").alias(f"weight{k}")), ["lang", "_c"], "left").drop("_g", "_c")
    rows = rows.join(symbols, "lang", "left")
    p = 1 / F.coalesce("symbols", F.lit(1 << 16))
    for k in range(1, ORDER + 1):
        p = F.coalesce(f"part{k}", F.lit(0.0)) + F.coalesce(f"weight{k}", F.lit(1.0)) * p
    return rows.select("lang", "gram", F.log(p).alias("logp"))


def _scores(docs: DataFrame, table: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """(doc_id, lang, n, nll) for every row: characters and the sum of -log p."""
    spark = docs.sparkSession
    count_of = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in blocks.items()))
    number = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), count_of[F.col("lang")])
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(
        F.col("lang"), number.cast("int").alias("block"), F.lit(1).alias("kind"), "doc_id", "text",
        F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("logp"),
    ).union(table.select(
        "lang", F.explode(F.sequence(F.lit(0), (count_of[F.col("lang")] - 1).cast("int"))), F.lit(0), F.lit(None).cast(kind),
        F.lit(None).cast("string"), "gram", "logp",
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, known, logp = None, [], np.empty(0, np.int64), np.empty(0)
        for b in batches:
            out: list[list] = [[], [], [], []]
            lang, block, kind = (b.column(i).to_pylist() for i in range(3))
            for k in range(len(b)):
                if at != (lang[k], block[k]):
                    at, held, known = (lang[k], block[k]), [], None
                if kind[k] == 0:
                    stop = k + 1
                    if not held or held[-1][0] is not b or held[-1][2] != k:
                        held.append([b, k, stop])
                    else:
                        held[-1][2] = stop
                    continue
                if known is None:
                    known = np.concatenate([x.column(5).slice(i, j - i).to_numpy(zero_copy_only=False) for x, i, j in held] or [np.empty(0, np.int64)])
                    logp = np.concatenate([x.column(6).slice(i, j - i).to_numpy(zero_copy_only=False) for x, i, j in held] or [np.empty(0)])
                    held = []
                found = grams(b.column(4)[k].as_py())
                out[0].append(b.column(3)[k].as_py())
                out[1].append(lang[k])
                out[2].append(len(found))
                out[3].append(-float(logp[np.searchsorted(known, found)].sum()) if len(found) else 0.0)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (b.schema.field("doc_id").type, pa.string(), pa.int64(), pa.float64()))], ["doc_id", "lang", "n", "nll"])

    dealt = rows.repartition(partitions(spark), "lang", "block").sortWithinPartitions("lang", "block", "kind", "gram")
    return dealt.mapInArrow(run, f"doc_id {kind.simpleString()}, lang string, n bigint, nll double")


def quality(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, lang, perplexity, threshold, kept) for every row. trusted: the doc_id of trusted documents."""
    spark = docs.sparkSession
    stages = Stages(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = trusted.select("doc_id").dropna().distinct().withColumn("trusted", F.lit(True))
    # by a shuffle at every size, so that small and large inputs take the same way
    flagged = rows.join(known.hint("merge"), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    counts = stages.keep(_count(flagged))
    table = stages.keep(gram_probabilities(stages, counts))
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # a row for each language
    blocks = {r["lang"]: -(-(r["bytes"] or 1) // block_bytes) for r in sizes} or {"": 1}
    del flagged
    release(spark)  # the text as counted, before it moves again
    scores = stages.keep(_scores(rows, table, blocks))
    scored = scores.join(known, "doc_id", "left")
    mean = scored.filter("trusted and n > 0").groupBy("lang").agg((F.sum("nll") / F.sum("n")).alias("mean"))
    smooth = scored.join(mean, "lang", "left").withColumn(
        "rate", F.when(F.col("n") > 0, (F.col("nll") + SHRINK * F.coalesce("mean", F.col("nll") / F.col("n"))) / (F.col("n") + SHRINK))
    )
    limit = smooth.filter("trusted and n > 0").groupBy("lang").agg((SLACK * F.percentile_approx("rate", quantile, 10000)).alias("limit"))
    return smooth.join(limit, "lang", "left").select(
        "doc_id", "lang", F.exp(F.col("nll") / F.when(F.col("n") > 0, F.col("n"))).alias("perplexity"), F.exp("limit").alias("threshold"),
        ((F.col("n") > 0) & (F.col("limit").isNull() | (F.col("rate") <= F.col("limit")))).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; trusted are those labelled as of good quality and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1 and toxic = 0"))
