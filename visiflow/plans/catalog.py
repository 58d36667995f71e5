"""Registry of named queries and their DuckDB oracle SQL.

Each query is a function ``(spark, sf_dir) -> DataFrame`` built only from
library operators.  The oracle, when given, is ANSI SQL over the raw test
tables that must return the same rows (floats rounded to 4 decimals on both
sides, integers as BIGINT, timestamps naive).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        DOCS[name] = (fn.__doc__ or "").strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from visiflow.plans import (q_clean, q_windows, q_joins, q_state, q_metrics,  # noqa: F401
                                q_models, q_scoring, q_timeline, q_stream, q_files, q_sinks, q_pooled)
