"""Registering named queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with SQL where SQL can say the same."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def steady(c: Column | str, digits: int) -> Column:
    """Round away from exact ties, which engines break differently."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, digits)


def steady_sql(c: str, digits: int) -> str:
    return f"round({c} + 1e-9, {digits})"
