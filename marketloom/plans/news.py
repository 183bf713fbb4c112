"""News signals and their point-in-time features per (symbol, session)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.calendar import OPEN, local_clock, trading_days

NEWS_FEATURES = [
    "sentiment_24h", "sentiment_72h", "news_count_24h", "news_count_72h",
    "positive_count_24h", "negative_count_24h",
    "has_earnings_announcement_today", "has_dividend_announcement_today",
    "has_discovery_announcement_today",
]
NOT_TICKERS = ("MACRO", "GENERAL", "OTHER")


def relevant_symbols(signals: DataFrame) -> DataFrame:
    """One row per (signal, symbol): the primary symbol and every matched one, upper case."""
    names = F.array_distinct(
        F.transform(
            F.array_compact(
                F.concat(F.array("primary_symbol"), F.coalesce("matched_symbols", F.array().cast("array<string>")))
            ),
            F.upper,
        )
    )
    return signals.withColumn("symbol", F.explode(names))


def feature_sessions(aligned: DataFrame, calendar: DataFrame, ahead: int = 5) -> DataFrame:
    """Trading days from the first aligned session to ``ahead`` trading days past the last."""
    days = trading_days(calendar)
    span = aligned.agg(F.min("session_target_date").alias("lo"), F.max("session_target_date").alias("hi"))
    last = days.filter(F.col("session_date") > span.select("hi").scalar()).orderBy("session_date").limit(ahead)
    return days.filter(
        (F.col("session_date") >= span.select("lo").scalar())
        & (F.col("session_date") <= last.agg(F.max("session_date")).scalar())
    )


def session_grid(symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every symbol on every session: an exploded date range met with the session days."""
    span = sessions.agg(F.min("session_date").alias("lo"), F.max("session_date").alias("hi"))
    dates = F.sequence(span.select("lo").scalar(), span.select("hi").scalar())
    return (
        symbols.select("symbol").distinct()
        .select("symbol", F.explode(dates).alias("session_date"))
        .join(sessions, "session_date", "left_semi")
    )


def news_features(
    signals: DataFrame, symbols: DataFrame, sessions: DataFrame, published: str = "published_at"
) -> DataFrame:
    """Counts and mean score over (open - 24 h, open] and (open - 72 h, open] per symbol and session.

    A signal belongs to the first daily opening at or after it; the 24 h window is
    exactly that day's group and the 72 h window that day and the two before. So the
    signals are first summed per (symbol, day) with map-side partials, and only those
    sums are spread over three days. No range join, no growth with hot symbols.
    """
    local = local_clock(F.col(published))
    opening = local - F.make_dt_interval(mins=F.lit(OPEN))
    late = F.to_date(opening)
    first_open = F.when(opening == late.cast("timestamp_ntz"), late).otherwise(F.date_add(late, 1))
    score = F.coalesce(F.col("sentiment_score"), F.lit(0.0))
    category = F.upper("event_category")
    daily = (
        relevant_symbols(signals)
        .select("symbol", first_open.alias("_open_day"), score.alias("_s"), category.alias("_c"))
        .groupBy("symbol", "_open_day")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("_s").alias("_sum"),
            F.count_if(F.col("_s") > 0.05).alias("_pos"),
            F.count_if(F.col("_s") < -0.05).alias("_neg"),
            *[F.max((F.col("_c") == c).cast("int")).alias(f"_{c}") for c in ("EARNINGS", "DIVIDEND", "DISCOVERY")],
        )
    )
    spread = daily.withColumn("_age", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn(
        "session_date", F.date_add("_open_day", F.col("_age"))
    )
    today = F.col("_age") == 0

    def now(c: str):
        return F.sum(F.when(today, F.col(c)).otherwise(0))

    sums = spread.groupBy("symbol", "session_date").agg(
        now("_n").alias("_n24"), F.sum("_n").alias("_n72"),
        F.sum(F.when(today, F.col("_sum"))).alias("_s24"), F.sum("_sum").alias("_s72"),
        now("_pos").alias("_p"), now("_neg").alias("_q"),
        now("_EARNINGS").alias("_e"), now("_DIVIDEND").alias("_d"), now("_DISCOVERY").alias("_x"),
    )
    zero = F.lit(0)
    return (
        session_grid(symbols, sessions)
        .join(sums, ["symbol", "session_date"], "left")
        .select(
            "symbol",
            "session_date",
            F.coalesce(F.bround(F.try_divide("_s24", "_n24"), 4), F.lit(0.0)).alias("sentiment_24h"),
            F.coalesce(F.bround(F.try_divide("_s72", "_n72"), 4), F.lit(0.0)).alias("sentiment_72h"),
            F.coalesce("_n24", zero).alias("news_count_24h"),
            F.coalesce("_n72", zero).alias("news_count_72h"),
            F.coalesce("_p", zero).alias("positive_count_24h"),
            F.coalesce("_q", zero).alias("negative_count_24h"),
            F.coalesce("_e", zero).cast("int").alias("has_earnings_announcement_today"),
            F.coalesce("_d", zero).cast("int").alias("has_dividend_announcement_today"),
            F.coalesce("_x", zero).cast("int").alias("has_discovery_announcement_today"),
        )
    )
