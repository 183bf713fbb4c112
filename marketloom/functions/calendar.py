"""Trading calendar rules and the mapping from publication time to session.

Publication times are TIMESTAMP_NTZ values on the UTC clock; the local clock is
derived with ``convert_timezone``, so nothing depends on the session time zone.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_TZ = "Asia/Karachi"

# Session times in minutes after local midnight.
OPEN, REGULAR_CLOSE = 9 * 60 + 15, 15 * 60 + 30
FRIDAY_BREAK, FRIDAY_REOPEN, FRIDAY_CLOSE = 12 * 60, 14 * 60 + 30, 16 * 60 + 30

# Yearly holidays (month, day).
FIXED_HOLIDAYS = ((2, 5), (3, 23), (5, 1), (8, 14), (11, 9), (12, 25))

# Declared holidays 2024-2026.
DECLARED_HOLIDAYS = (
    "2024-04-10", "2024-04-11", "2024-04-12", "2024-06-17", "2024-06-18", "2024-06-19",
    "2024-07-16", "2024-07-17", "2024-09-16",
    "2025-03-31", "2025-04-01", "2025-04-02", "2025-06-06", "2025-06-07", "2025-06-08",
    "2025-07-05", "2025-07-06", "2025-09-05",
    "2026-03-20", "2026-03-21", "2026-03-22", "2026-05-27", "2026-05-28", "2026-05-29",
    "2026-06-25", "2026-06-26", "2026-08-25",
)


class Calendar:
    """Holiday rules; ``add`` and ``remove`` adjust the declared dates."""

    def __init__(self, declared=DECLARED_HOLIDAYS, add=(), remove=()) -> None:
        self.declared = sorted((set(map(str, declared)) | set(map(str, add))) - set(map(str, remove)))

    def is_holiday(self, day: Column) -> Column:
        fixed = (F.month(day) * 100 + F.dayofmonth(day)).isin([m * 100 + d for m, d in FIXED_HOLIDAYS])
        declared = [dt.date.fromisoformat(d) for d in self.declared]
        return (fixed | day.isin(declared)) if declared else fixed

    def is_trading_day(self, day: Column) -> Column:
        return (F.weekday(day) < 5) & ~self.is_holiday(day)

    @property
    def reach(self) -> int:
        """Days that always contain a trading day: more weekdays than there are holidays to skip."""
        return 7 * (math.ceil((len(self.declared) + 2 * len(FIXED_HOLIDAYS)) / 5) + 1)

    def with_neighbours(self, days: DataFrame, day: str = "day") -> DataFrame:
        """Adds is_trading, next_trading and prev_trading to a table of dates (a small dimension)."""
        d = F.col(day)
        return days.withColumns(
            {
                "is_trading": self.is_trading_day(d),
                "next_trading": F.filter(
                    F.sequence(F.date_add(d, 1), F.date_add(d, self.reach)), self.is_trading_day
                )[0],
                "prev_trading": F.filter(
                    F.sequence(F.date_add(d, -1), F.date_add(d, -self.reach), F.expr("INTERVAL -1 DAY")),
                    self.is_trading_day,
                )[0],
            }
        )

    def between(self, spark: SparkSession, start: str, end: str) -> DataFrame:
        """The calendar dimension for a closed date range."""
        days = spark.range(1).select(
            F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
        )
        return self.with_neighbours(days)

    def covering(self, df: DataFrame, day: Column, before: int = 0, after: int = 0) -> DataFrame:
        """The calendar dimension over the date range of a table (one row per day)."""
        span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
        days = span.select(
            F.explode(F.sequence(F.date_add("lo", -before), F.date_add("hi", after))).alias("day")
        )
        return self.with_neighbours(days)


def trading_days(calendar: DataFrame) -> DataFrame:
    return calendar.filter("is_trading").select(F.col("day").alias("session_date"))


def session_windows(calendar: DataFrame) -> DataFrame:
    """Opening windows of each trading day; Friday is split by a break."""

    def part(kind: str, start: int, end: int) -> Column:
        return F.struct(
            F.lit(kind).alias("session_type"),
            F.lit(start).alias("open_minute"),
            F.lit(end).alias("close_minute"),
        )

    friday = F.array(
        part("FRIDAY_SESSION_1", OPEN, FRIDAY_BREAK), part("FRIDAY_SESSION_2", FRIDAY_REOPEN, FRIDAY_CLOSE)
    )
    other = F.array(part("REGULAR", OPEN, REGULAR_CLOSE))
    return (
        calendar.filter("is_trading")
        .select("day", F.explode(F.when(F.weekday("day") == 4, friday).otherwise(other)).alias("s"))
        .select("day", "s.*")
    )


# -- publication time -------------------------------------------------------------

# Accepted text formats once a leading weekday name is removed.
LOCAL_FORMATS = (
    "yyyy-MM-dd h:mm a", "yyyy-MM-dd h:mm:ss a", "MMM d, yyyy h:mm a", "MMM d, yyyy", "MMMM d, yyyy",
    "d-MMM-yyyy", "d MMM yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "yyyy/MM/dd HH:mm:ss",
)
OFFSET_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")


def _in_utc(local: Column) -> Column:
    return F.convert_timezone(F.lit(LOCAL_TZ), F.lit("UTC"), local)


def parse_published(text: Column) -> Column:
    """Text to a UTC-clock TIMESTAMP_NTZ; no offset means local time; unparsable gives null."""
    s = F.regexp_replace(F.trim(text), r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,\s*", "")
    has_offset = s.rlike(r"(?:Z|GMT|UTC|[+-]\d{2}:?\d{2})$") & s.rlike(r"\d:\d")
    iso_local = s.try_cast("timestamp_ntz")
    local = F.coalesce(
        iso_local,
        *[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in LOCAL_FORMATS],
    )
    instant = F.coalesce(s.try_cast("timestamp"), *[F.try_to_timestamp(s, F.lit(f)) for f in OFFSET_FORMATS])
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))
    return F.when(has_offset, utc).otherwise(_in_utc(local))


def local_clock(published: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_TZ), published)


def align_to_sessions(df: DataFrame, calendar: DataFrame, published: str = "published_at") -> DataFrame:
    """First session in which an item can be acted on, by one join to the calendar on the local date."""
    src = df.withColumn("_local", local_clock(F.col(published))).withColumn("_day", F.to_date("_local"))
    dim = calendar.select(F.col("day").alias("_day"), "is_trading", "next_trading")
    j = src.join(dim, "_day", "left")
    seconds = F.hour("_local") * 3600 + F.minute("_local") * 60 + F.second("_local")
    micros = F.date_format("_local", "SSSSSS").cast("int")
    minute = seconds / 60
    friday = F.weekday("_day") == 4
    next_type = F.when(F.weekday("next_trading") == 4, "FRIDAY_SESSION_1").otherwise("REGULAR")
    today, later, second = F.col("_day"), F.col("next_trading"), "FRIDAY_SESSION_2"

    def outcome(target: Column, kind, opening: int, intraday: bool) -> Column:
        return F.struct(
            target.alias("session_target_date"),
            (kind if isinstance(kind, Column) else F.lit(kind)).alias("session_type"),
            F.lit(opening).alias("_open"),
            F.lit(intraday).alias("is_intraday"),
        )

    after_close = (minute > REGULAR_CLOSE) | ((minute == REGULAR_CLOSE) & (micros > 0))
    rule = (
        F.when(~F.col("is_trading"), outcome(later, next_type, OPEN, False))
        .when(friday & (minute < OPEN), outcome(today, "FRIDAY_SESSION_1", OPEN, False))
        .when(friday & (minute < FRIDAY_BREAK), outcome(today, second, FRIDAY_REOPEN, True))
        .when(friday & (minute < FRIDAY_REOPEN), outcome(today, second, FRIDAY_REOPEN, False))
        .when(friday & (minute < FRIDAY_CLOSE), outcome(later, "REGULAR", OPEN, True))
        .when(friday, outcome(later, "REGULAR", OPEN, False))
        .when(minute < OPEN, outcome(today, "REGULAR", OPEN, False))
        .when(after_close, outcome(later, next_type, OPEN, False))
        .otherwise(outcome(later, next_type, OPEN, True))
    )
    j = j.withColumn("_r", rule).select(
        *df.columns, "_local", "_r.session_target_date", "_r.session_type", "_r._open", "_r.is_intraday"
    )
    usable = F.col("session_target_date").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("_open"))
    wait = F.timestamp_diff("MICROSECOND", F.col("_local"), F.col("usable_from")) / 3600e6
    return (
        j.withColumn("usable_from", usable)
        .withColumn("published_local", F.col("_local"))
        .withColumn("hours_to_session", F.greatest(F.lit(0.0), wait))
        .drop("_local", "_open")
    )


def alignment_summary(aligned: DataFrame) -> DataFrame:
    """Counts per session type with intraday split and the session span (rollup gives the total row)."""
    return aligned.rollup("session_type").agg(
        F.count(F.lit(1)).alias("signals"),
        F.count_if("is_intraday").alias("intraday"),
        F.count_if(~F.col("is_intraday")).alias("after_hours"),
        F.min("session_target_date").alias("first_session"),
        F.max("session_target_date").alias("last_session"),
        F.countDistinct("session_target_date").alias("sessions"),
    ).withColumn("session_type", F.coalesce("session_type", F.lit("ALL")))
