"""Registry that the query modules fill."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(x, name: str | None = None, digits: int = 6) -> Column:
    """Rounded result column; adding 0.0 turns a negative zero into zero."""
    col = F.col(x) if isinstance(x, str) else x
    out = F.round(col.cast("double"), digits) + F.lit(0.0)
    label = name or (x if isinstance(x, str) else None)
    return out.alias(label) if label else out


def q6(expr: str, name: str | None = None, digits: int = 6) -> str:
    """The same rounding in SQL text."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE)" + (f" AS {name}" if name else "")
