"""All named queries and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gyrolake.plans import estimators, evaluations, experiments, geometry, reports, sourced, streams

#: Modules with QUERIES: name -> (query, SQL or None).
MODULES = [geometry, reports, streams, estimators, evaluations, sourced, experiments]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
