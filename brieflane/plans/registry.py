"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus the DuckDB oracle SQL.

Every query reads the landed tables derived from the given parquet (see
``brieflane.sources.fixtures``) over their whole extent.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

_MODULES = ["q_posts", "q_config", "q_sources", "q_text", "q_market", "q_report", "q_landing", "q_ext"]


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is equivalent DuckDB SQL (omit if not expressible)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"brieflane.plans.{m}")


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
