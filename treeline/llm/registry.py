"""Queries of this subpackage and, where SQL can say the same, their SQL. All modules are imported with this one."""

from __future__ import annotations

from treeline.llm import bpe, chat_format, decontaminate, exact_dedup, language_id, line_dedup, ngram_join, quality, secrets, token_counts

_MODULES = {
    "op1_secret_scan": secrets, "op2_language_id": language_id, "op3_quality_classifier": quality, "op4_bpe": bpe, "op5_token_counts": token_counts,
    "op6_chat_formatting": chat_format, "op7_benchmark_decontamination": decontaminate, "op8_line_dedup": line_dedup, "op9_exact_dedup": exact_dedup, "op10_ngram_jaccard_join": ngram_join,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
