"""Gap detection and data-quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.windows import per_symbol


def weekdays_before(day: Column) -> Column:
    """Weekdays since Monday 1970-01-05, the day itself not counted (closed form, no date list)."""
    n = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def weekdays_between(start: Column, end: Column) -> Column:
    """Weekdays in [start, end)."""
    return weekdays_before(end) - weekdays_before(start)


def gaps(bars: DataFrame, max_gap_days: int = 4, min_weekdays: int = 3) -> DataFrame:
    prev = F.lag("trade_date").over(per_symbol())
    return (
        bars.select("symbol", "trade_date", prev.alias("gap_start"))
        .withColumn("calendar_days", F.datediff("trade_date", "gap_start"))
        .withColumn(
            "missing_weekdays",
            weekdays_between(F.date_add("gap_start", 1), F.col("trade_date")).cast("bigint"),
        )
        .filter((F.col("calendar_days") > max_gap_days) & (F.col("missing_weekdays") >= min_weekdays))
        .select("symbol", "gap_start", F.col("trade_date").alias("gap_end"), "calendar_days", "missing_weekdays")
    )


def quality_report(bars: DataFrame) -> DataFrame:
    """One row per symbol: span, coverage, events, gaps, health; a single pass over the bars."""
    prev = F.lag("trade_date").over(per_symbol())
    d = bars.withColumn("_prev", prev).withColumn(
        "_missing",
        F.when(
            F.datediff("trade_date", "_prev") > 4,
            weekdays_between(F.date_add("_prev", 1), F.col("trade_date")),
        ),
    )
    big = F.col("_missing") >= 3
    agg = d.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.count_if("is_upper_lock").alias("upper_locks"),
        F.count_if("is_lower_lock").alias("lower_locks"),
        F.count_if(F.col("dividend_amount") > 0).alias("dividend_events"),
        F.sum("dividend_amount").alias("total_dividends"),
        F.count_if(F.col("split_ratio") != 1.0).alias("split_events"),
        F.count_if(F.col("volume") == 0).alias("zero_volume_sessions"),
        F.count_if(big).alias("gap_count"),
        F.coalesce(F.sum(F.when(big, F.col("_missing"))), F.lit(0)).cast("bigint").alias("gap_weekdays"),
        F.count_if(F.col("_missing") >= 10).alias("critical_gaps"),
    )
    expected = weekdays_between(F.col("first_date"), F.date_add("last_date", 1)).cast("bigint")
    return (
        agg.withColumn("span_days", F.datediff("last_date", "first_date") + 1)
        .withColumn("expected_weekdays", expected)
        .withColumn("coverage", F.col("sessions") / F.greatest("expected_weekdays", F.lit(1)))
        .withColumn(
            "health",
            F.when(
                (F.col("sessions") < 10) | (F.col("critical_gaps") >= 2) | (F.col("coverage") < 0.60),
                "CRITICAL",
            )
            .when((F.col("gap_count") > 0) | (F.col("coverage") < 0.85), "WARNING")
            .otherwise("HEALTHY"),
        )
    )


def quality_rollup(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("symbols"),
        F.count_if(F.col("health") == "HEALTHY").alias("healthy"),
        F.count_if(F.col("health") == "WARNING").alias("warning"),
        F.count_if(F.col("health") == "CRITICAL").alias("critical"),
        F.sum("sessions").alias("total_sessions"),
    )
