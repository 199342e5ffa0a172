"""Every query of the library over the given tables, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonelake.queries import evidence, files, journals, layouts, places, plans, projections, reports, rows, samples, sessions, signals, streams

_PARTS = (samples, evidence, sessions, plans, places, streams, files, rows, signals, journals, layouts, reports, projections)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for part in _PARTS for f in part.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
