"""Queries of the corpus operators, by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

import importlib

#: Query name and the module that holds its function ``opN``.
_MODULES = {
    "op1_toxicity": ("toxicity", "op1"),
    "op4_quality_rules": ("quality", "op4"),
    "op6_language_id": ("langid", "op6"),
    "op2_html_text": ("html_text", "op2"),
    "op10_warc": ("warc", "op10"),
    "op3_mix_sources": ("mixing", "op3"),
    "op5_secret_scan": ("secrets", "op5"),
    "op8_decontaminate": ("decontaminate", "op8"),
    "op7_suffix_array_dedup": ("suffix_dedup", "op7"),
    "op9_simhash_near_dedup": ("simhash", "op9"),
    "op11_importance_resampling": ("resampling", "op11"),
    "op12_conversation_repair": ("conversations", "op12"),
    "op13_url_filter": ("url_filter", "op13"),
}

_SQL = {
    "op3_mix_sources": ("mixing", "OP3_SQL"),
    "op8_decontaminate": ("decontaminate", "OP8_SQL"),
    "op11_importance_resampling": ("resampling", "OP11_SQL"),
    "op12_conversation_repair": ("conversations", "OP12_SQL"),
    "op13_url_filter": ("url_filter", "OP13_SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tallyforge.llm.{module}"), function) for name, (module, function) in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"tallyforge.llm.{module}"), text) for name, (module, text) in _SQL.items()}
