"""The named queries of this subpackage and the DuckDB SQL some of them are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = [
    "bpe", "line_dedup", "html_extract", "sharding", "language", "ngram_join", "exact_dedup", "mixing", "quality_model", "quality_rules",
    "variants", "divergence", "toxicity",
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def keep(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql.strip()
        return build

    return keep


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"foldwise.llm.{name}")
