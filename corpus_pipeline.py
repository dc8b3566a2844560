"""A training corpus from the documents table: toxicity filter, near copies, repeated passages, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxwarden.llm import mixing, packing, simhash, suffix_array, toxicity
from fluxwarden.llm.common import Stages


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose probability of a toxic grade is above one half."""
    return toxicity.keep_clean(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: fingerprints of three-word shingles, three or fewer differing bits."""
    return simhash.keep_one_of_each(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes and the passages of over 50 words that also start elsewhere. Every document
    stays, if need be empty."""
    return suffix_array.remove_repeats(docs, words=51)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages below their target weight are repeated; none is given up."""
    return mixing.mix(docs, mixing.labelled_languages(docs, _labels(spark, sf_dir)), mixing.WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", drop_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL has no trained models, fingerprints or packing; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    stages = Stages(spark)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        rows = stages.keep(stage(spark, rows, sf_dir))
    return rows
