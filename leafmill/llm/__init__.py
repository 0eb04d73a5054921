"""Operators for training data. Nothing else in the library imports this subpackage.

Each module holds one operator, its ``QUERIES`` and, where SQL can express the
result, its ``SQL``; :func:`queries` and :func:`oracle_sql` gather them.
"""

from __future__ import annotations

import importlib

MODULES = ("pieces", "markup", "packing", "truncation", "neighbours", "scans", "encoding", "mixing", "language")


def _modules():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    """All queries of the subpackage by name."""
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """The SQL of those queries that SQL can express."""
    return {k: v for m in _modules() for k, v in getattr(m, "SQL", {}).items()}
