"""All queries of the engine's own operators with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from setflow.workloads import learning, matrices, nested, shapes, tpch

    return [tpch, shapes, matrices, nested, learning]


def queries() -> dict[str, Query]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLE.items()}
