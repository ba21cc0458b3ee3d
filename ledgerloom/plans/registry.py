"""How a module of driver queries registers its queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def registry() -> tuple[dict, dict, Callable]:
    """(queries, sql, decorator): the decorator takes the SQL, or None where SQL cannot say it."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
