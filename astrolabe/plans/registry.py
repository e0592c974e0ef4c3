"""Registry of named queries (Spark callables) and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables.
Modules under :mod:`astrolabe.plans` register themselves on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    # import for the side effect of registration
    from astrolabe.plans import (  # noqa: F401
        q_composite,
        q_graph,
        q_ml,
        q_models,
        q_relational,
        q_scalar,
        q_search,
        q_sources,
        q_text,
    )
