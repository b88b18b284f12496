"""Registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from regiolens.llm import (
    chat_format,
    decontaminate,
    embedding_dedup,
    hard_negatives,
    jaccard_join,
    lang_id,
    license_scan,
    mixing,
    phrases,
    quality,
    secrets,
    substring_dedup,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": decontaminate.op1_query,
    "op2_license_scan": license_scan.op2_query,
    "op3_chat_format": chat_format.op3_query,
    "op4_quality": quality.op4_query,
    "op5_url_filter": url_filter.op5_query,
    "op6_embedding_dedup": embedding_dedup.op6_query,
    "op7_language_id": lang_id.op7_query,
    "op8_jaccard_join": jaccard_join.op8_query,
    "op9_secret_scan": secrets.op9_query,
    "op10_mix_sources": mixing.op10_query,
    "op11_phrase_mining": phrases.op11_query,
    "op12_hard_negatives": hard_negatives.op12_query,
    "op13_substring_dedup": substring_dedup.op13_query,
}

ORACLES: dict[str, str] = {
    "op3_chat_format": chat_format.ORACLE,
    "op10_mix_sources": mixing.ORACLE,
    "op11_phrase_mining": phrases.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_substring_dedup": substring_dedup.ORACLE,
}
