"""Registration of queries and their SQL checks, plus small SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if check:
            CHECKS[name] = check
        return fn

    return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round the named columns so that both engines print the same value."""
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


def r(c: Column | str, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


def sr(expr: str, n: int = 6) -> str:
    """SQL rounding; adding zero turns -0.0 into 0.0."""
    return f"(round(({expr})::DOUBLE, {n}) + 0e0)"
