"""Queries of this subpackage and, where SQL states them, their SQL."""

from __future__ import annotations

import importlib

MODULES = {
    "op1_token_codes": "token_codes",
    "op2_piece_sampling": "piece_sampling",
    "op3_ngram_join": "ngram_join",
    "op4_suffix_dedup": "suffix_dedup",
    "op5_exact_dedup": "exact_dedup",
    "op6_chat_tree": "chat_tree",
    "op7_language_id": "language_id",
    "op8_media_webp": "media_webp",
    "op9_line_dedup": "line_dedup",
    "op10_source_mix": "source_mix",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{m}"), name) for name, m in MODULES.items()}


def oracle_sql() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{m}"), "SQL", None) for name, m in MODULES.items()}
    return {k: v for k, v in found.items() if v}
