"""E: trading calendar and session alignment; news features per session."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.registry import query, r, sr
from marketloom.functions import calendar as cal
from marketloom.plans import news as nw

CAL = cal.Calendar()
HOLIDAYS = ", ".join(f"DATE '{d}'" for d in cal.DECLARED_HOLIDAYS)
TRADING = f"""(isodow(d) < 6 AND NOT (d IN ({HOLIDAYS}) OR (month(d), day(d)) IN
  ((2, 5), (3, 23), (5, 1), (8, 14), (11, 9), (12, 25))))"""


def days_sql(lo: str, hi: str, src: str) -> str:
    return f"""
days AS (SELECT CAST(unnest(generate_series({lo}, {hi}, INTERVAL 1 DAY)) AS DATE) AS d FROM {src}),
cal AS (SELECT d AS day, {TRADING} AS is_trading FROM days),
caln AS (
  SELECT *, min(CASE WHEN is_trading THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_trading,
         max(CASE WHEN is_trading THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_trading
  FROM cal)"""


BARS_DAYS = fx.BARS + "," + days_sql("min(trade_date) - INTERVAL 60 DAY", "max(trade_date) + INTERVAL 60 DAY",
                                     "(SELECT trade_date FROM bars)") + """,
span AS (SELECT min(trade_date) AS lo, max(trade_date) AS hi FROM bars),
inner_days AS (SELECT caln.* FROM caln, span WHERE day BETWEEN lo AND hi)"""


def bars_calendar(spark, sf):
    return CAL.covering(fx.bars(spark, sf), F.col("trade_date"))


@query("e1_holiday_flags", fx.sql(fx.BARS, f"""
SELECT trade_date, count(*) AS bars, (trade_date IN ({HOLIDAYS}) OR strftime(trade_date, '%m-%d') IN
  ('02-05', '03-23', '05-01', '08-14', '11-09', '12-25')) AS is_holiday FROM bars GROUP BY trade_date"""))
def e1(spark, sf):
    return fx.bars(spark, sf).groupBy("trade_date").agg(F.count(F.lit(1)).alias("bars")).withColumn(
        "is_holiday", CAL.is_holiday(F.col("trade_date")))


@query("e2_trading_day_flags", fx.sql(fx.BARS, f"""
SELECT symbol, d AS trade_date, {TRADING} AS is_trading FROM (SELECT symbol, trade_date AS d FROM bars)"""))
def e2(spark, sf):
    return fx.bars(spark, sf).select("symbol", "trade_date", CAL.is_trading_day(F.col("trade_date")).alias("is_trading"))


@query("e3_adjacent_trading_days", fx.sql(BARS_DAYS, "SELECT day, next_trading, prev_trading FROM inner_days"))
def e3(spark, sf):
    return bars_calendar(spark, sf).select("day", "next_trading", "prev_trading")


@query("e4_trading_days_in_range", fx.sql(BARS_DAYS, "SELECT day AS session_date FROM inner_days WHERE is_trading"))
def e4(spark, sf):
    return cal.trading_days(bars_calendar(spark, sf))


@query("e5_session_windows", fx.sql(BARS_DAYS, """
SELECT day, 'REGULAR' AS session_type, 555 AS open_minute, 930 AS close_minute FROM inner_days WHERE is_trading AND isodow(day) <> 5
UNION ALL SELECT day, 'FRIDAY_SESSION_1', 555, 720 FROM inner_days WHERE is_trading AND isodow(day) = 5
UNION ALL SELECT day, 'FRIDAY_SESSION_2', 870, 990 FROM inner_days WHERE is_trading AND isodow(day) = 5"""))
def e5(spark, sf):
    return cal.session_windows(bars_calendar(spark, sf))


@query("e6_parse_publication_time", """
SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL WHEN 3 THEN date_trunc('day', ts) - INTERVAL 5 HOUR
         WHEN 0 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts)
         WHEN 5 THEN date_trunc('minute', ts) - INTERVAL 5 HOUR
         ELSE date_trunc('second', ts) - INTERVAL 5 HOUR END AS published_utc
FROM events""")
def e6(spark, sf):
    ts, k = F.col("ts"), F.col("event_id") % 7
    text = (
        F.when(k == 0, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(k == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(k == 3, F.date_format(ts, "MMM d, yyyy"))
        .when(k == 4, F.concat(F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(k == 5, F.date_format(ts, "yyyy-MM-dd h:mm a"))
        .otherwise("soon")
    )
    return fx.table(spark, sf, "events").select("event_id", cal.parse_published(text).alias("published_utc"))


ALIGN = days_sql("min(ts) - INTERVAL 60 DAY", "max(ts) + INTERVAL 60 DAY", "(SELECT ts FROM events)") + """,
loc AS (SELECT event_id, ts + INTERVAL 5 HOUR AS l, CAST(ts + INTERVAL 5 HOUR AS DATE) AS day,
               CAST(ts + INTERVAL 5 HOUR AS TIME) AS t FROM events),
pick AS (
  SELECT event_id, l, t, is_trading, isodow(day) = 5 AS fri,
         CASE WHEN NOT is_trading THEN next_trading
              WHEN isodow(day) = 5 AND t < TIME '14:30:00' THEN day
              WHEN isodow(day) <> 5 AND t < TIME '09:15:00' THEN day ELSE next_trading END AS target
  FROM loc JOIN caln USING (day)),
aligned AS (
  SELECT event_id, target AS session_target_date,
         CASE WHEN is_trading AND fri AND t < TIME '09:15:00' THEN 'FRIDAY_SESSION_1'
              WHEN is_trading AND fri AND t < TIME '14:30:00' THEN 'FRIDAY_SESSION_2'
              WHEN is_trading AND fri THEN 'REGULAR'
              WHEN is_trading AND t < TIME '09:15:00' THEN 'REGULAR'
              WHEN isodow(target) = 5 THEN 'FRIDAY_SESSION_1' ELSE 'REGULAR' END AS session_type,
         CASE WHEN is_trading AND fri AND t >= TIME '09:15:00' AND t < TIME '14:30:00'
              THEN target + TIME '14:30:00' ELSE target + TIME '09:15:00' END AS usable_from,
         l AS published_local,
         is_trading AND ((fri AND t >= TIME '09:15:00' AND t < TIME '16:30:00' AND NOT (t >= TIME '12:00:00' AND t < TIME '14:30:00'))
              OR (NOT fri AND t >= TIME '09:15:00' AND t <= TIME '15:30:00')) AS is_intraday
  FROM pick)"""


def aligned_events(spark, sf):
    ev = fx.table(spark, sf, "events").select("event_id", "ts")
    dim = CAL.covering(ev, F.to_date(cal.local_clock(F.col("ts"))))
    return cal.align_to_sessions(ev, dim, "ts").drop("ts")


@query("e7_session_alignment", fx.sql(ALIGN, f"""
SELECT *, {sr('greatest(0, date_diff(\'microsecond\', published_local, usable_from) / 3600e6)')} AS hours_to_session FROM aligned"""))
def e7(spark, sf):
    return aligned_events(spark, sf).withColumn("hours_to_session", r("hours_to_session"))


SIG_DAYS = fx.SIGNALS + "," + days_sql("min(published_at) - INTERVAL 60 DAY", "max(published_at) + INTERVAL 60 DAY",
                                       "(SELECT published_at FROM signals)")
SIG_ALIGN = SIG_DAYS + """,
sal AS (
  SELECT signal_id, CASE WHEN NOT is_trading THEN next_trading WHEN isodow(day) = 5 AND t < TIME '14:30:00' THEN day
              WHEN isodow(day) <> 5 AND t < TIME '09:15:00' THEN day ELSE next_trading END AS session_target_date
  FROM (SELECT signal_id, CAST(published_at + INTERVAL 5 HOUR AS DATE) AS day, CAST(published_at + INTERVAL 5 HOUR AS TIME) AS t FROM signals)
  JOIN caln USING (day)),
sess AS (
  SELECT day AS session_date FROM caln WHERE is_trading AND day >= (SELECT min(session_target_date) FROM sal)
    AND day <= (SELECT max(day) FROM (SELECT day FROM caln WHERE is_trading AND day > (SELECT max(session_target_date) FROM sal) ORDER BY day LIMIT 5)))"""


def signals_aligned(spark, sf):
    sig = fx.scored_signals(spark, sf)
    dim = CAL.covering(sig, F.to_date(cal.local_clock(F.col("published_at"))), after=60)
    return cal.align_to_sessions(sig, dim), dim


@query("e8_batch_alignment", fx.sql(SIG_ALIGN, "SELECT * FROM sal"))
def e8(spark, sf):
    return signals_aligned(spark, sf)[0].select("signal_id", "session_target_date")


@query("e9_alignment_summary", fx.sql(ALIGN, """
SELECT coalesce(session_type, 'ALL') AS session_type, count(*) AS signals, count(*) FILTER (is_intraday) AS intraday,
       count(*) FILTER (NOT is_intraday) AS after_hours, min(session_target_date) AS first_session,
       max(session_target_date) AS last_session, count(DISTINCT session_target_date) AS sessions
FROM aligned GROUP BY GROUPING SETS ((session_type), ())"""))
def e9(spark, sf):
    return cal.alignment_summary(aligned_events(spark, sf))


NEWS = SIG_ALIGN + """,
rel AS (
  SELECT DISTINCT signal_id, published_at, sentiment_score, event_category, upper(s) AS symbol
  FROM (SELECT *, unnest(list_append(matched_symbols, primary_symbol)) AS s FROM signals) WHERE s IS NOT NULL),
syms AS (SELECT DISTINCT upper(replace(p_brand, '#', '')) AS symbol FROM part),
nf AS (
  SELECT s.symbol, d.session_date,
         count(*) FILTER (age < INTERVAL 24 HOUR) AS n24, count(r.signal_id) AS n72,
         avg(sentiment_score) FILTER (age < INTERVAL 24 HOUR) AS s24, avg(sentiment_score) AS s72,
         count(*) FILTER (age < INTERVAL 24 HOUR AND sentiment_score > 0.05) AS p24,
         count(*) FILTER (age < INTERVAL 24 HOUR AND sentiment_score < -0.05) AS q24,
         coalesce(bool_or(age < INTERVAL 24 HOUR AND event_category = 'EARNINGS'), false) AS e,
         coalesce(bool_or(age < INTERVAL 24 HOUR AND event_category = 'DIVIDEND'), false) AS dv,
         coalesce(bool_or(age < INTERVAL 24 HOUR AND event_category = 'DISCOVERY'), false) AS x
  FROM syms s CROSS JOIN sess d
  LEFT JOIN (SELECT *, session_date + TIME '09:15:00' - (published_at + INTERVAL 5 HOUR) AS age
             FROM rel JOIN (SELECT session_date FROM sess) ON published_at + INTERVAL 5 HOUR <= session_date + TIME '09:15:00'
              AND published_at + INTERVAL 5 HOUR > session_date + TIME '09:15:00' - INTERVAL 72 HOUR) r
    ON r.symbol = s.symbol AND r.session_date = d.session_date
  GROUP BY ALL),
news AS (
  SELECT symbol, session_date, coalesce(CAST(round_even(s24, 4) AS DOUBLE), 0e0) AS sentiment_24h,
         coalesce(CAST(round_even(s72, 4) AS DOUBLE), 0e0) AS sentiment_72h,
         n24 AS news_count_24h, n72 AS news_count_72h, p24 AS positive_count_24h, q24 AS negative_count_24h,
         e::INT AS has_earnings_announcement_today, dv::INT AS has_dividend_announcement_today,
         x::INT AS has_discovery_announcement_today
  FROM nf)"""


def news_table(spark, sf):
    aligned, dim = signals_aligned(spark, sf)
    return nw.news_features(aligned, fx.universe(spark, sf), nw.feature_sessions(aligned, dim))


@query("e10_news_features", fx.sql(NEWS, "SELECT * FROM news"))
def e10(spark, sf):
    return news_table(spark, sf)


@query("e11_symbol_relevance", fx.sql(NEWS, "SELECT signal_id, symbol FROM rel"))
def e11(spark, sf):
    return nw.relevant_symbols(fx.scored_signals(spark, sf)).select("signal_id", "symbol")


@query("e12_feature_horizon", fx.sql(SIG_ALIGN, "SELECT session_date FROM sess"))
def e12(spark, sf):
    return nw.feature_sessions(*signals_aligned(spark, sf))
