"""Registered queries: each name maps to a Spark builder ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB twin used by the correctness gate.

Registered outputs are flat and comparable: arrays are serialised with
``array_join(.., ',')`` and doubles that come from long sums are rounded to 6.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query builder (and its twin SQL, if any)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so the registry is filled."""
    import importlib
    for mod in QUERY_MODULES:
        importlib.import_module(f"tokenmill.queries.{mod}")


QUERY_MODULES = ("corpus_queries", "block_queries", "storage_queries", "plan_queries",
                 "telemetry_queries", "vocab_queries", "chat_queries", "stream_queries")
