"""All driver queries: name, DataFrame builder and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    from . import q_arrays, q_core, q_models, q_prep, q_search, q_service, q_text

    return (q_text, q_prep, q_search, q_arrays, q_models, q_core, q_service)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.SQL
    return out
