"""All queries of the library by name, and their SQL. ``query`` registers a function with the SQL that gives its rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "rank_score"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ("entity_queries", "text_queries", "form_queries", "report_queries", "repair_queries", "check_queries", "stream_queries")


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"loam.plans.{m}")
