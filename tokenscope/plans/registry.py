"""All queries of the engine and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tokenscope.plans import caches, catalog, cost, live, reports, scalars, services, stateful, text, vectors

MODULES = (cost, scalars, text, catalog, vectors, stateful, reports, services, caches, live)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
