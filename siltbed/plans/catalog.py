"""Where queries are registered, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, body: str | None = None, *tables: str, recursive: bool = False) -> Callable:
    """Registers a function of Tables; ``body`` is its SQL over the named derived tables."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if body is not None:
            ORACLE_SQL[name] = sql(body, *tables, recursive=recursive)
        return f

    return keep
