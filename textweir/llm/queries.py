"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_language_id": "language_id",
    "op2_nearest_neighbours": "ann",
    "op3_url_filters": "url_filters",
    "op4_simhash_near_dedup": "simhash",
    "op5_best_fit_packing": "packing",
    "op6_benchmark_decontamination": "decontamination",
    "op7_quality_classifier": "quality",
    "op8_chat_formatting": "chat_format",
    "op9_token_binary_output": "token_output",
    "op10_lm_scoring": "lm_scoring",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in ((n, importlib.import_module(f"{__package__}.{m}")) for n, m in _MODULES.items()) if getattr(module, "ORACLE_SQL", None)}
