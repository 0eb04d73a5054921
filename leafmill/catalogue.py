"""All queries of the core and their SQL, gathered from the modules that hold them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("sources.rejects", "queries.surface", "queries.views", "queries.trees", "queries.shapes", "queries.arrivals", "queries.reading", "queries.flow")


def _modules():
    return [importlib.import_module(f"leafmill.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {k: v for m in _modules() for k, v in getattr(m, "SQL", {}).items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The query the driver smoke-checks."""
    return queries()["flagship_segments"](spark, folder)
