"""The corpus operators' queries and SQL, by name."""

from __future__ import annotations

from . import chat_format, embedding_dedup, hard_negatives, importance_resampling, quality_classifier, quality_rules, sentencepiece_codec, simhash, source_mix, token_counts, topk_search, toxicity, url_filter

_MODULES = {
    "op1_source_mix": source_mix,
    "op2_simhash_dedup": simhash,
    "op3_sentencepiece": sentencepiece_codec,
    "op4_embedding_dedup": embedding_dedup,
    "op5_url_filter": url_filter,
    "op6_token_counts": token_counts,
    "op7_chat_format": chat_format,
    "op8_toxicity": toxicity,
    "op9_quality_rules": quality_rules,
    "op10_quality_classifier": quality_classifier,
    "op11_topk_search": topk_search,
    "op12_importance_resampling": importance_resampling,
    "op13_hard_negatives": hard_negatives,
}


def queries() -> dict:
    """Name -> callable (spark, sf_dir) -> DataFrame."""
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can express the query."""
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
