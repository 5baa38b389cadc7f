"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_quality": "quality",
    "op2_ngram_jaccard_join": "ngram_join",
    "op3_decontamination": "decontamination",
    "op4_language_id": "language_id",
    "op5_substring_dedup": "substring_dedup",
    "op6_line_dedup": "line_dedup",
    "op7_packing": "packing",
    "op8_chat_format": "chat",
    "op9_media_columns": "media",
    "op10_suffix_array_dedup": "suffix_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, module in MODULES.items() if (sql := getattr(importlib.import_module(f".{module}", __package__), "ORACLE_SQL", None))}
