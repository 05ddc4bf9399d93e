"""The registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the SQL of its result, if SQL can state it."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def steady(value: Column | str, digits: int) -> Column:
    """Rounded mean or ratio; a nudge keeps exact halves from depending on sum order.

    The reference SQL rounds ``value + 1e-9`` too.
    """
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + 1e-9, digits)
