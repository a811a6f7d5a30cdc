"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op10_jaccard_join, op1_chat_format, op2_byte_bpe, op3_decontaminate, op4_token_file, op5_substring_dedup, op6_suffix_array, op7_exact_dedup, op8_language_id, op9_quality

_MODULES = {
    "op1_chat_format": op1_chat_format,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_file": op4_token_file,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_suffix_array": op6_suffix_array,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_quality": op9_quality,
    "op10_jaccard_join": op10_jaccard_join,
}


def queries() -> dict:
    import corpus_pipeline

    return {name: m.query for name, m in _MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
