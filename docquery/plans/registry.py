"""Names of the library's queries, their Spark plans and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docquery.plans import memory_plans, run_plans, search_plans, stream_plans, text_plans

FLAGSHIP = "j9_retrieve"
_PLANS = (search_plans, memory_plans, text_plans, run_plans, stream_plans)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for p in _PLANS for name, q in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _PLANS for name, sql in p.SQL.items()}
