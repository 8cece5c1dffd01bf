"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = (
    "op1_best_fit_packing",
    "op2_suffix_dedup",
    "op3_source_mixing",
    "op4_ngram_join",
    "op5_quality_rules",
    "op6_chat_formatting",
    "op7_secret_scan",
    "op8_exact_dedup",
    "op9_pii_sanitising",
    "op10_quality_classifier",
    "op11_vector_codes",
    "op12_importance_resampling",
    "op13_decontamination",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f".{name}", __package__), name) for name in _MODULES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f".{name}", __package__), f"{name.split('_')[0].upper()}_SQL", None) for name in _MODULES}
    return {name: sql for name, sql in found.items() if sql}
