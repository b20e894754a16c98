"""Registry of named queries: a Spark callable and, where SQL can express it, its check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql:
            CHECKS[name] = sql
        return fn

    return add


def day(name: str | Column) -> Column:
    """Days leave the registry as text, so every engine prints them alike."""
    return F.date_format(name, "yyyy-MM-dd")


def yes_no(name: str) -> Column:
    return F.when(F.col(name), "yes").when(~F.col(name), "no")
