"""Operations of a pipeline for training data. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, importance, language_id, mixing, near_dedup, ngram_model, pieces, suffix_dedup, topk_search, toxicity, url_filter, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_chat_format": chat.op4_chat_format,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_ngram_jaccard": near_dedup.op6_ngram_jaccard,
        "op7_topk_search": topk_search.op7_topk_search,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_importance": importance.op11_importance,
        "op12_lm_scoring": ngram_model.op12_lm_scoring,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE_SQL,
        "op3_source_mixing": mixing.ORACLE_SQL,
        "op4_chat_format": chat.ORACLE_SQL,
        "op5_url_filter": url_filter.ORACLE_SQL,
        "op7_topk_search": topk_search.ORACLE_SQL,
        "op11_importance": importance.ORACLE_SQL,
    }
