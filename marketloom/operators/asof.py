"""Backward as-of join: union of both sides and a running ``last`` (no range join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.dedupe import keep_last


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    tie_order: list[str] | None = None,
) -> DataFrame:
    """Each left row gets the values of the latest right row at or before its time.

    Only the distinct (key, time) pairs of the left side enter the ordered window;
    its rows are matched back by an equi-join. A hot key therefore costs one window
    partition of its distinct times, not of its rows.
    """
    right = keep_last(right.select(*keys, right_time, *dict.fromkeys([*values, *(tie_order or [])])),
                      [*keys, right_time], tie_order or [right_time])
    times = left.select(*keys, left_time).distinct()
    packed = F.struct(*values)
    both = times.select(
        *keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
        F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType).alias("_v"),
    ).unionByName(
        right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_v"))
    )
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        both.withColumn("_hit", F.last("_v", ignorenulls=True).over(w))
        .filter("_side = 1")
        .select(*keys, F.col("_t").alias(left_time), *[F.col(f"_hit.{v}").alias(v) for v in values])
    )
    return left.join(found, [*keys, left_time], "left")
