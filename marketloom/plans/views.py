"""Read-side queries: listings, history, overview, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.windows import per_symbol
from marketloom.plans.registry import latest_per_symbol


def universe_listing(universe: DataFrame, bars: DataFrame, sector: str | None = None, enabled_only: bool = False) -> DataFrame:
    out = universe
    if enabled_only:
        out = out.filter("enabled")
    if sector is not None:
        out = out.filter(F.lower("sector") == sector.lower())
    stored = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.max("trade_date").alias("latest_date")
    )
    return out.join(stored, "symbol", "left").withColumn("has_data", F.col("total_sessions").isNotNull())


def last_sessions(bars: DataFrame, n: int = 30, symbol: str | None = None) -> DataFrame:
    """The newest n sessions of each symbol (a tail report)."""
    rows = bars if symbol is None else bars.filter(F.col("symbol") == symbol.strip().upper())
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    return rows.withColumn("_rn", F.row_number().over(newest_first)).filter(F.col("_rn") <= n).drop("_rn")


def market_overview(universe: DataFrame, bars: DataFrame, registry: DataFrame) -> DataFrame:
    """Last close, one-day change, latest signal and probability per instrument."""
    prev = F.lag("close").over(per_symbol())
    change = F.coalesce(F.try_divide(F.col("close") - prev, prev) * 100.0, F.lit(0.0))
    last = bars.select("symbol", "trade_date", "close", change.alias("_chg")).groupBy("symbol").agg(
        F.max("trade_date").alias("last_session"), F.max_by("close", "trade_date").alias("latest_close"),
        F.max_by("_chg", "trade_date").alias("change_1d"),
    )
    pred = latest_per_symbol(registry).select(
        "symbol", "signal", (F.col("up_probability") * 100.0).alias("up_probability_pct")
    )
    return (
        universe.select("symbol", "name", "sector")
        .join(last, "symbol", "left")
        .join(pred, "symbol", "left")
        .withColumn("signal", F.coalesce("signal", F.lit("N/A")))
        .withColumn("data_status", F.when(F.col("last_session").isNotNull(), "Ready").otherwise("Missing"))
    )


def search(overview: DataFrame, text: str = "", sector: str | None = None) -> DataFrame:
    """Case-insensitive substring of symbol or name, optional sector."""
    needle = text.strip().lower()
    out = overview
    if needle:
        out = out.filter(F.lower("symbol").contains(needle) | F.lower("name").contains(needle))
    return out if sector is None else out.filter(F.col("sector") == sector)


def distributions(overview: DataFrame) -> DataFrame:
    """Instruments per sector with the signal mix as columns."""
    return overview.groupBy("sector").agg(
        F.count(F.lit(1)).alias("instruments"),
        *[F.count_if(F.col("signal") == s).alias(s.lower()) for s in ("BUY", "HOLD", "SELL")],
    )


def counters(universe: DataFrame, bars: DataFrame, registry: DataFrame) -> DataFrame:
    with_data = universe_listing(universe, bars)
    return with_data.agg(
        F.count(F.lit(1)).alias("configured"), F.count_if("enabled").alias("enabled"),
        F.count_if("has_data").alias("with_data"),
    ).withColumn("predictions", registry.agg(F.count(F.lit(1))).scalar())
