"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fluxwarden.llm import (
    chat, chunks, cover_tree, hard_negatives, kneser_ney, mixing, packing, quality_rules, simhash, spelling, suffix_array,
    toxicity, url_templates,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op5_kneser_ney": kneser_ney.query,
    "op3_suffix_array": suffix_array.query,
    "op9_mixing": mixing.query,
    "op8_toxicity": toxicity.query,
    "op6_chunk_fingerprints": chunks.query,
    "op4_url_templates": url_templates.query,
    "op7_cover_tree": cover_tree.query,
    "op1_packing": packing.query,
    "op10_simhash": simhash.query,
    "op2_chat_format": chat.query,
    "op11_spelling_variants": spelling.query,
    "op12_quality_rules": quality_rules.query,
    "op13_hard_negatives": hard_negatives.query,
}

ORACLE: dict[str, str] = {
    "op2_chat_format": chat.ORACLE_SQL,
    "op12_quality_rules": quality_rules.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
