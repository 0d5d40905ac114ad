"""Corpus operators for training-data pipelines.

Each module holds one operator with a general interface, and a thin query
``query(spark, sf_dir)`` that applies it to whole tables.  Nothing else in the
library imports this package.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module that holds ``query`` and, where SQL can say it, ``ORACLE_SQL``.
MODULES = {
    "op1_lm_scoring": "lm_scoring",
    "op5_decontamination": "decontamination",
    "op4_substring_dedup": "substring_dedup",
    "op3_ngram_jaccard_join": "jaccard_join",
    "op2_packing": "packing",
    "op6_quality_rules": "quality_rules",
    "op7_quality_classifier": "quality_classifier",
    "op8_url_filters": "url_filters",
    "op9_license_scans": "license_scans",
    "op10_token_counts": "token_counts",
    "op11_spelling_variants": "spelling_variants",
    "op12_merkle_manifest": "merkle_manifest",
    "op13_secret_scans": "secret_scans",
}


def _module(name: str):
    return importlib.import_module(f"{__name__}.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(_module(name), "ORACLE_SQL", None))}
