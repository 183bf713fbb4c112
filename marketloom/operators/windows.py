"""Window specs and recursive-filter helpers.

Every spec here partitions by instrument. After key dedupe a table of daily bars
has at most one row per (symbol, day), so one window partition is bounded by the
number of calendar days on record (about 366 a year) however large the raw feed
or however hot the symbol. Raw, unbounded inputs never reach these specs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MAX_BLOCK = 512


def per_symbol(order: str = "trade_date", keys: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, spec: WindowSpec | None = None) -> WindowSpec:
    """The last n rows, current one included."""
    return (spec or per_symbol()).rowsBetween(-(n - 1), 0)


def running(spec: WindowSpec | None = None) -> WindowSpec:
    return (spec or per_symbol()).rowsBetween(Window.unboundedPreceding, 0)


def full_window(agg: Column, x: Column, n: int, spec: WindowSpec | None = None) -> Column:
    """An aggregate over the trailing n rows that is null until n values exist."""
    w = trailing(n, spec)
    return F.when(F.count(x).over(w) == n, agg.over(w))


@dataclass(frozen=True)
class Ewm:
    """One recursive mean: y = (1 - alpha) * y_prev + alpha * x, started at row ``start``."""

    name: str
    x: Column
    alpha: float
    start: int = 0
    min_rows: int = 1


def block_length(series: list[Ewm]) -> int:
    """Rows per block such that the rescaling powers stay below 1e200."""
    fastest = max(-math.log(1.0 - s.alpha) for s in series)
    return max(2, min(MAX_BLOCK, int(460.0 / fastest)))


def with_rolling_sums(df: DataFrame, x: str, spec: WindowSpec | None = None) -> DataFrame:
    """Sums of the last 5, 10, 20, 50 and 200 values as ``{x}_sum{n}``, null until n values exist.

    Only the 5-row frame is summed directly. Longer sums add shifted shorter ones
    (200 = four times 50 = twenty times 10), so a row costs a few offsets instead of
    200 additions, and no running total drifts.
    """
    w = spec or per_symbol()

    def shifted(col: str, step: int, times: int) -> Column:
        total = F.col(col)
        for k in range(1, times):
            total = total + F.lag(col, k * step).over(w)
        return total

    s = {n: f"{x}_sum{n}" for n in (5, 10, 20, 50, 200)}
    out = df.withColumn(s[5], full_window(F.sum(x), F.col(x), 5, w))
    out = out.withColumn(s[10], shifted(s[5], 5, 2))
    out = out.withColumns({s[20]: shifted(s[10], 10, 2), s[50]: shifted(s[10], 10, 5)})
    return out.withColumn(s[200], shifted(s[50], 50, 4))


def with_ewm(
    df: DataFrame,
    series: list[Ewm],
    order: str = "trade_date",
    keys: tuple[str, ...] = ("symbol",),
    block: int | None = None,
) -> DataFrame:
    """Recursive means as plain windows, all series in one pass.

    Rows are numbered per key and cut into blocks. Inside a block the mean is a
    running sum with weights rescaled to the block start, so powers stay small.
    Blocks are chained by a geometric sum over earlier block ends, taken with
    ``lag`` among block-end rows only, and handed forward with ``last``. All specs
    contain ``keys``, so the one exchange on ``keys`` serves every sort. No UDF.
    """
    block = block or block_length(series)
    w = Window.partitionBy(*keys).orderBy(order)
    rn, blk, pos, end = "_ewm_rn", "_ewm_blk", "_ewm_pos", "_ewm_end"
    out = df.withColumns(
        {rn: F.row_number().over(w) - 1, **{f"_ewm_x_{s.name}": s.x.cast("double") for s in series}}
    )
    out = out.withColumns(
        {
            blk: F.floor(F.col(rn) / block),
            pos: F.col(rn) % block,
            end: F.col(rn) % block == block - 1,
        }
    )
    in_block = (
        Window.partitionBy(*keys, blk).orderBy(rn).rowsBetween(Window.unboundedPreceding, 0)
    )
    scaled = {}
    for s in series:
        q = 1.0 - s.alpha
        weight = (
            F.when(F.col(rn) < s.start, 0.0).when(F.col(rn) == s.start, 1.0).otherwise(s.alpha)
        )
        term = F.coalesce(F.col(f"_ewm_x_{s.name}"), F.lit(0.0)) * weight * F.pow(F.lit(q), -F.col(pos))
        scaled[f"_ewm_s_{s.name}"] = F.sum(term).over(in_block) * F.pow(F.lit(q), F.col(pos))
    out = out.withColumns(scaled)

    ends = Window.partitionBy(*keys, end).orderBy(rn)
    chained = {}
    for s in series:
        q_block = (1.0 - s.alpha) ** block
        depth = math.ceil(math.log(1e-17) / math.log(q_block)) + 1
        total = F.col(f"_ewm_s_{s.name}")
        for k in range(1, depth):
            total = total + F.lit(q_block**k) * F.coalesce(
                F.lag(f"_ewm_s_{s.name}", k).over(ends), F.lit(0.0)
            )
        chained[f"_ewm_e_{s.name}"] = F.when(F.col(end), total)
    out = out.withColumns(chained)

    before = w.rowsBetween(Window.unboundedPreceding, -1)
    result = {}
    for s in series:
        carry = F.last(f"_ewm_e_{s.name}", ignorenulls=True).over(before)
        value = F.col(f"_ewm_s_{s.name}") + F.pow(F.lit(1.0 - s.alpha), F.col(pos) + 1) * F.coalesce(
            carry, F.lit(0.0)
        )
        result[s.name] = F.when(F.col(rn) - s.start + 1 >= s.min_rows, value)
    out = out.withColumns(result)
    return out.drop(*[c for c in out.columns if c.startswith("_ewm_")])


def longest_run(df: DataFrame, flag: Column, keys: list[str], order: str, name: str) -> DataFrame:
    """Longest run of consecutive true rows per key (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(order)
    islands = df.select(
        *keys,
        F.when(flag, 1).otherwise(0).alias("_hit"),
        F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_isl"),
    )
    return (
        islands.groupBy(*keys, "_isl")
        .agg(F.sum("_hit").alias("_len"))
        .groupBy(*keys)
        .agg(F.max("_len").alias(name))
    )
