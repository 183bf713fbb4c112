"""Supervised targets; the last rows, whose future is unknown, stay null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.windows import per_symbol
from marketloom.schemas import price_column

NOISE_BAND = 0.0075


def next_day_direction(p: Column) -> Column:
    nxt = F.lead(p, 1).over(per_symbol())
    return F.when(nxt.isNotNull(), F.when(nxt > p, 1.0).otherwise(0.0))


def next_day_3class(p: Column, threshold: float = NOISE_BAND) -> Column:
    """+1 / -1 outside the band, 0 inside it or on its edge (return rounded to 8 places)."""
    nxt = F.lead(p, 1).over(per_symbol())
    r = F.round(F.try_divide(nxt - p, p), 8)
    return F.when(
        nxt.isNotNull(), F.when(r > threshold, 1.0).when(r < -threshold, -1.0).otherwise(0.0)
    )


def forward_return(p: Column, horizon: int = 5) -> Column:
    return F.try_divide(F.lead(p, horizon).over(per_symbol()), p) - 1.0


def prediction_targets(df: DataFrame) -> DataFrame:
    p = price_column(df).cast("double")
    return df.withColumns(
        {
            "target_next_day_dir": next_day_direction(p),
            "target_next_day_3class": next_day_3class(p),
            "target_return_5d": forward_return(p, 5),
        }
    )
