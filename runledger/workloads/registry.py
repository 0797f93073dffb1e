from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register a query under ``name`` with its SQL over the named views (none: checked by tests only)."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return fn

    return add
