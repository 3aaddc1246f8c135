"""Queries over the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.llm import bpe, chat, divergence, exact_dedup, html_extract, lm_scoring, media, packing, sharding, simhash, toxicity, url_filter, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_simhash": simhash.op2_simhash,
        "op3_packing": packing.op3_packing,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_media": media.op6_media,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_lm_scoring": lm_scoring.op8_lm_scoring,
        "op9_bpe": bpe.op9_bpe,
        "op10_html": html_extract.op10_html,
        "op11_divergence": divergence.op11_divergence,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_sharding": sharding.op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_filter": url_filter.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op11_divergence": divergence.ORACLE,
        "op12_vector_codes": vector_codes.ORACLE,
        "op13_sharding": sharding.ORACLE,
    }
