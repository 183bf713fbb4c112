"""Macro series: normalisation, point-in-time daily table, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.dedupe import keep_last

MACRO_KEY = ["indicator", "observation_date", "public_release_date"]

# Output column, source indicator and the constant used when it is absent.
SERIES = (
    ("usd_pkr", "USD_PKR", 278.50),
    ("sbp_policy_rate", "SBP_POLICY_RATE", 10.0),
    ("kibor_6m", "KIBOR_6M", 10.65),
    ("cpi_yoy", "CPI_YOY", 5.0),
    ("brent_crude", "BRENT_CRUDE", 80.0),
    ("kse100_index", "KSE_100", 80000.0),
)
RETURNS = {"usd_pkr": "usd_pkr_return_1d", "brent_crude": "brent_return_1d", "kse100_index": "kse100_return_1d"}
MACRO_FEATURES = [
    "usd_pkr", "usd_pkr_return_1d", "sbp_policy_rate", "kibor_6m", "cpi_yoy",
    "brent_crude", "brent_return_1d", "kse100_index", "kse100_return_1d",
]
KIBOR_SPREAD = 0.65


def market_observations(quotes: DataFrame, indicator: str, places: int, unit: str, source: str) -> DataFrame:
    """(obs_date, close) quotes to long rows; a market price is public on its own day."""
    return quotes.filter(F.col("close") > 0).select(
        F.lit(indicator).alias("indicator"),
        F.col("obs_date").alias("observation_date"),
        F.col("obs_date").alias("public_release_date"),
        F.bround("close", places).alias("value"),
        F.lit(unit).alias("unit"),
        F.lit("DAILY").alias("frequency"),
        F.lit(source).alias("source"),
    )


def benchmark_rates(policy: DataFrame, spread: float = KIBOR_SPREAD) -> DataFrame:
    """Interbank benchmark derived from the policy rate."""
    return policy.withColumns(
        {"indicator": F.lit("KIBOR_6M"), "value": F.bround(F.col("value") + spread, 2)}
    )


def release_table(releases: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Wide release rows (observation, release, one column per measure) to long form."""
    return (
        releases.unpivot(
            ["observation_date", "public_release_date"], list(measures), "_measure", "value"
        )
        .withColumn("indicator", F.element_at(F.create_map(*[F.lit(x) for kv in measures.items() for x in kv]), F.col("_measure")))
        .select("indicator", "observation_date", "public_release_date", "value")
    )


def dedupe_raw(raw: DataFrame, order: list[str]) -> DataFrame:
    return keep_last(raw, MACRO_KEY, order)


def point_in_time(raw: DataFrame, sessions: DataFrame, names: list[str], backfill_leading: bool = False) -> DataFrame:
    """Long (session, indicator, value): the value most recently released by that session.

    One window partition per indicator, holding one row per session and per release day.
    ``backfill_leading`` copies the first known value to earlier sessions, which looks ahead.
    """
    released = keep_last(
        raw.filter(F.col("indicator").isin(names)).select(
            "indicator", F.col("public_release_date").alias("session_date"), "observation_date", "value"
        ),
        ["indicator", "session_date"],
        ["observation_date"],
    )
    asked = sessions.select("session_date", F.explode(F.array(*[F.lit(n) for n in names])).alias("indicator"))
    both = asked.select("indicator", "session_date", F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_side")).unionByName(
        released.select("indicator", "session_date", F.col("value").alias("_v"), F.lit(0).alias("_side"))
    )
    w = Window.partitionBy("indicator").orderBy("session_date", "_side")
    whole = Window.partitionBy("indicator")
    out = both.withColumns(
        {
            "value": F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_known": F.count("_v").over(whole),
        }
    ).filter("_side = 1")
    if backfill_leading:
        newest_first = Window.partitionBy("indicator").orderBy(F.desc("session_date")).rowsBetween(
            Window.unboundedPreceding, 0
        )
        out = out.withColumn("value", F.coalesce("value", F.last("value", ignorenulls=True).over(newest_first)))
    return out.select("indicator", "session_date", "value", "_known")


def daily_change(value: Column, prev: Column) -> Column:
    return F.bround(F.coalesce(F.try_divide(value, prev) - 1.0, F.lit(0.0)), 5)


def macro_daily(raw: DataFrame, sessions: DataFrame, backfill_leading: bool = False) -> DataFrame:
    """One row per session with the six series, their constants where absent, and three daily changes."""
    names = [indicator for _, indicator, _ in SERIES]
    defaults = F.create_map(*[F.lit(x) for _, i, d in SERIES for x in (i, d)])
    long = point_in_time(raw, sessions, names, backfill_leading)
    long = long.withColumn(
        "value", F.when(F.col("_known") == 0, F.element_at(defaults, F.col("indicator"))).otherwise(F.col("value"))
    )
    prev = F.lag("value").over(Window.partitionBy("indicator").orderBy("session_date"))
    long = long.withColumn("_chg", daily_change(F.col("value"), prev))

    def pick(indicator: str, column: str) -> Column:
        return F.max(F.when(F.col("indicator") == indicator, F.col(column)))

    wide = long.groupBy("session_date").agg(
        *[pick(i, "value").alias(c) for c, i, _ in SERIES],
        *[pick(i, "_chg").alias(RETURNS[c]) for c, i, _ in SERIES if c in RETURNS],
    )
    return wide.select("session_date", *MACRO_FEATURES)


def macro_summary(raw: DataFrame, daily: DataFrame) -> DataFrame:
    """Points and indicators collected, sessions covered, latest values."""
    points = raw.agg(
        F.count(F.lit(1)).alias("points"), F.array_sort(F.collect_set("indicator")).alias("indicators")
    )
    latest = F.max_by(F.struct(*[F.bround(c, 2).alias(c) for c, _, _ in SERIES]), "session_date")
    days = daily.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"),
        latest.alias("_l"),
    ).select("sessions", "first_session", "last_session", *[F.col(f"_l.{c}").alias(f"latest_{c}") for c, _, _ in SERIES])
    return days.withColumns(
        {"points": points.select("points").scalar(), "indicators": points.select("indicators").scalar()}
    )
