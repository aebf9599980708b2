"""Named queries over the driver's tables, with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as evaluation
from .plans import assembled, records  # noqa: F401  they register their queries beside them

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [evaluation]


def queries() -> dict[str, Query]:
    return {name: query for m in _modules() for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
