"""Validation, price-limit flags, corporate-action adjustment and incremental merge of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.dedupe import keep_first, keep_last
from marketloom.operators.windows import per_symbol
from marketloom.schemas import PRICES, col_or

KEY = ["symbol", "trade_date"]
EPS = 1e-6


def clean_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def with_reasons(df: DataFrame) -> DataFrame:
    """Normalised rows plus an array naming every rule the row breaks (empty = valid)."""
    d = df.withColumns(
        {
            "symbol": clean_symbol(F.col("symbol")),
            "adjusted_close": col_or(df, "adjusted_close", F.col("close")),
            "dividend_amount": col_or(df, "dividend_amount", 0.0),
            "split_ratio": col_or(df, "split_ratio", 1.0),
            "is_upper_lock": col_or(df, "is_upper_lock", False),
            "is_lower_lock": col_or(df, "is_lower_lock", False),
        }
    )
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))

    def broken(rule: Column, name: str) -> Column:
        return F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))

    rules = [
        broken(F.col("symbol").rlike(r"^[\p{L}\p{N}]+$"), "symbol"),
        broken(F.col("trade_date").isNotNull(), "trade_date"),
        *[broken(F.col(x) > 0, f"{x}_positive") for x in ("open", "high", "low", "close", "adjusted_close")],
        broken(F.col("volume") >= 0, "volume"),
        broken(F.col("dividend_amount") >= 0, "dividend"),
        broken(F.col("split_ratio") > 0, "split"),
        broken(h >= lo - EPS, "high_below_low"),
        broken(h >= o - EPS, "high_below_open"),
        broken(h >= c - EPS, "high_below_close"),
        broken(lo <= o + EPS, "low_above_open"),
        broken(lo <= c + EPS, "low_above_close"),
    ]
    return d.withColumn("reasons", F.array_compact(F.array(*rules)))


def valid_rows(df: DataFrame) -> DataFrame:
    return with_reasons(df).filter(F.size("reasons") == 0).drop("reasons")


def quarantine(df: DataFrame) -> DataFrame:
    return with_reasons(df).filter(F.size("reasons") > 0)


def validate_prices(df: DataFrame, order: list[str]) -> DataFrame:
    """Valid rows, one per (symbol, day): the last by ingest order."""
    return keep_last(valid_rows(df), KEY, order)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when nothing is left; the test stops at the first row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def empty_prices(spark) -> DataFrame:
    return spark.createDataFrame([], PRICES)


def lock_flags(df: DataFrame) -> DataFrame:
    """Sessions that moved by the daily limit and traded flat."""
    prev = F.lag("close").over(per_symbol())
    move, pct = F.col("close") - prev, F.try_divide(F.col("close") - prev, prev)
    flat = F.abs(F.col("high") - F.col("low")) < F.col("close") * 0.005 + 1e-4
    cheap = F.col("close") <= 15.0
    return df.withColumns(
        {
            "is_upper_lock": F.coalesce(((pct >= 0.074) | ((move >= 0.99) & cheap)) & flat, F.lit(False)),
            "is_lower_lock": F.coalesce(((pct <= -0.074) | ((move <= -0.99) & cheap)) & flat, F.lit(False)),
        }
    )


def action_factor(prev_close: Column) -> Column:
    """Factor that one session's dividend and split apply to every earlier close."""
    split, div = F.coalesce("split_ratio", F.lit(1.0)), F.coalesce("dividend_amount", F.lit(0.0))
    by_split = F.when((split > 0) & (F.abs(split - 1.0) > 1e-4), 1.0 / split).otherwise(1.0)
    by_div = F.when(
        (div > 0) & (prev_close > 0), F.greatest(1.0 - div / prev_close, F.lit(0.0001))
    ).otherwise(1.0)
    return by_split * by_div


def adjust_close(df: DataFrame, name: str = "adjusted_close") -> DataFrame:
    """Back-adjusted close: close times the factors of all later sessions, 4 places half-even."""
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    later = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_f", action_factor(F.lead("close").over(newest_first)))
        .withColumn(name, F.bround(F.col("close") * F.coalesce(F.product("_f").over(later), F.lit(1.0)), 4))
        .drop("_f")
    )


def adjust_where_needed(df: DataFrame) -> DataFrame:
    """Adjust only symbols with any action; the others keep the provider's value."""
    acted = F.max(
        (F.coalesce("dividend_amount", F.lit(0.0)) > 0) | (F.coalesce("split_ratio", F.lit(1.0)) != 1.0)
    ).over(Window.partitionBy("symbol"))
    given = F.col("adjusted_close")
    return (
        adjust_close(df.withColumn("_acted", acted), "_adj")
        .withColumn("adjusted_close", F.when(F.col("_acted"), F.col("_adj")).otherwise(given))
        .drop("_acted", "_adj")
    )


def action_events(df: DataFrame) -> DataFrame:
    """Dividends and splits as an event table."""
    one = F.array(
        F.when(
            F.col("dividend_amount") > 0,
            F.struct(F.lit("DIVIDEND").alias("action_type"), F.col("dividend_amount").alias("value")),
        ),
        F.when(
            F.col("split_ratio") != 1.0,
            F.struct(F.lit("SPLIT").alias("action_type"), F.col("split_ratio").alias("value")),
        ),
    )
    return df.select(
        "symbol", F.col("trade_date").alias("ex_date"), F.explode(F.array_compact(one)).alias("a")
    ).select("symbol", "a.action_type", "ex_date", "a.value")


# -- providers --------------------------------------------------------------------


def failover(offers: DataFrame, priority: str = "priority") -> DataFrame:
    """Per symbol the rows of the first provider that has any (valid) row."""
    best = offers.groupBy("symbol").agg(F.min(priority).alias(priority))
    return offers.join(best, ["symbol", priority], "left_semi")


def backfill_bounds(
    chosen: DataFrame, offers: DataFrame, start: Column, end: Column, slack: int = 5, priority: str = "priority"
) -> DataFrame:
    """Where the chosen rows miss more than ``slack`` days at either end, merge the next provider keep-first."""
    bounds = chosen.groupBy("symbol").agg(
        F.min("trade_date").alias("_lo"), F.max("trade_date").alias("_hi"), F.min(priority).alias("_used")
    )
    short = bounds.filter(
        (F.datediff("_lo", start) > slack) | (F.datediff(end, "_hi") > slack)
    ).select("symbol", "_used")
    later = offers.join(short, "symbol").filter(F.col(priority) > F.col("_used")).drop("_used")
    return keep_first(chosen.unionByName(failover(later, priority)), KEY, [priority])


# -- load and incremental merge ---------------------------------------------------


def bootstrap(
    feed: DataFrame, order: list[str], stored: DataFrame | None = None, overwrite: bool = False
) -> DataFrame:
    """First load: validate, dedupe, flag, adjust; symbols already stored are skipped."""
    rows = validate_prices(feed, order)
    if stored is not None and not overwrite:
        rows = rows.join(stored.select("symbol").distinct(), "symbol", "left_anti")
    return adjust_where_needed(lock_flags(rows)).select(*PRICES.fieldNames())


def load_metrics(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count_if("is_upper_lock").alias("upper_locks"),
        F.count_if("is_lower_lock").alias("lower_locks"),
        F.count_if(F.col("dividend_amount") > 0).alias("dividends"),
        F.count_if(F.col("split_ratio") != 1.0).alias("splits"),
    )


def merge_increment(stored: DataFrame, delta: DataFrame) -> DataFrame:
    """History of every symbol that gains a session, re-adjusted as a whole.

    ``delta`` is validated. Only rows past the symbol's high-water mark count, so a
    repeated delta changes nothing. Symbols without new rows are not emitted; the
    caller overwrites just the emitted partitions.
    """
    mark = stored.groupBy("symbol").agg(F.max("trade_date").alias("_mark"))
    fresh = (
        delta.join(mark, "symbol", "left")
        .filter(F.col("_mark").isNull() | (F.col("trade_date") > F.col("_mark")))
        .drop("_mark")
    )
    touched = fresh.select("symbol").distinct()
    history = stored.join(touched, "symbol", "left_semi")
    return adjust_where_needed(history.unionByName(fresh))


def update_status(universe: DataFrame, stored: DataFrame, merged: DataFrame) -> DataFrame:
    """Per requested symbol: UPDATED, ALREADY_UP_TO_DATE, BOOTSTRAPPED or FAILED."""
    before = stored.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n0"), F.max("trade_date").alias("previous_latest")
    )
    after = merged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("_n1"), F.max("trade_date").alias("_new")
    )
    n0, n1 = F.coalesce("_n0", F.lit(0)), F.coalesce("_n1", F.lit(0))
    return (
        universe.select("symbol")
        .join(before, "symbol", "left")
        .join(after, "symbol", "left")
        .select(
            "symbol",
            F.when((n0 == 0) & (n1 > 0), "BOOTSTRAPPED")
            .when(n0 == 0, "FAILED")
            .when(n1 > n0, "UPDATED")
            .otherwise("ALREADY_UP_TO_DATE")
            .alias("status"),
            "previous_latest",
            F.coalesce("_new", "previous_latest").alias("new_latest"),
            F.when(n1 > n0, n1 - n0).otherwise(F.lit(0)).alias("records_added"),
            F.greatest(n0, n1).alias("total_records"),
        )
    )


def update_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("symbols"), F.sum("records_added").alias("records_added")
    )
