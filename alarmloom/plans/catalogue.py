"""All queries of the engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .forecast_queries import FORECAST, OTHER
from .log_queries import LOG
from .retrieval_queries import RETRIEVAL

ALL = {**LOG, **RETRIEVAL, **FORECAST, **OTHER}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
