"""Keyed dedupe.

A key may have any number of copies, so copies are folded with a map-side
aggregate (``max_by``/``min_by``) and never brought together in one window sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fold(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    rank: Column = F.struct(*[F.col(c) for c in order])
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that sorts last by ``order`` (a total order within the key)."""
    return _fold(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the one that sorts first by ``order`` (for example provider priority)."""
    return _fold(df, keys, order, F.min_by)


def new_only(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return df.join(known.select(*keys), keys, "left_anti")
