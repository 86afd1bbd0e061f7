"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> module that has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL
MODULES = {
    "op1_mixing": "mixing",
    "op2_url_filter": "url_filter",
    "op3_line_dedup": "line_dedup",
    "op4_ngram_join": "ngram_join",
    "op5_html_text": "html_text",
    "op6_sharding": "sharding",
    "op7_decontamination": "decontamination",
    "op8_language_id": "language_id",
    "op9_secret_scan": "secret_scan",
    "op10_fingerprints": "fingerprints",
    "op11_periodic_runs": "periodic_runs",
    "op12_fill_middle": "fill_middle",
    "op13_exact_dedup": "exact_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__name__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
