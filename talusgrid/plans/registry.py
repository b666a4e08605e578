"""All registered queries of the engine itself."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("retrieval", "catalog", "matching", "dialogue", "analytics", "rules", "ingestion", "serving", "fields")


def _suites():
    return [import_module(f"{__package__}.{name}").suite for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for suite in _suites() for name, f in suite.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for suite in _suites() for name, sql in suite.sql.items()}
