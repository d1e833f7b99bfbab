"""Registry of driver-checked queries.

``register(name, sql)`` attaches a Spark plan builder ``fn(spark, sf_dir)`` and,
when the operator is SQL-expressible, the independent DuckDB oracle text.  The
oracle is written from the definition, over the same parquet tables; fixture
views it uses are added as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sources.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None
    ids: tuple[str, ...]


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ids: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _REGISTRY:
            raise KeyError(f"query {name} registered twice")
        _REGISTRY[name] = Query(name, fn, with_views(sql) if sql else None, ids)
        return fn
    return deco


def _load() -> None:
    # importing the catalogue modules fills the registry
    from .plans import catalog_features, catalog_metrics, catalog_prep, catalog_ml  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load()
    return dict(_REGISTRY)
