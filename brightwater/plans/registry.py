"""Queries by name, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query; sql: its oracle."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def both(name: str, spark_sql: str, oracle: str | None = None, *tables: str) -> None:
    """A query in Spark SQL over views of the tables, and its oracle (the same text unless given)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..session import views

        views(spark, sf_dir, *tables)
        return spark.sql(spark_sql)

    register(name, spark_sql if oracle is None else oracle)(run)


def load() -> None:
    """Import the modules that register queries."""
    from . import domain, library, more, relational, scalar, surface, windowed  # noqa: F401
