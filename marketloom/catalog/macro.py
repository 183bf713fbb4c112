"""G (macro series) and H (multi-modal merge)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog import sessions as ss
from marketloom.catalog import indicators as ci
from marketloom.catalog.indicators import PLACES, RAW
from marketloom.catalog.registry import query, r, sr
from marketloom.plans import features as ft
from marketloom.plans import macro as mc


def quotes(spark, sf):
    return fx.table(spark, sf, "events").groupBy(F.to_date("ts").alias("obs_date")).agg(
        F.max("value").alias("top"), F.min("value").alias("low")
    ).select("obs_date", (F.col("top") - F.when(F.dayofmonth("obs_date") % 5 == 0, 1000.0).otherwise(0.0)).alias("close"))


@query("g1_market_observations", """
SELECT 'USD_PKR' AS indicator, d AS observation_date, d AS public_release_date,
       CAST(round_even(c, 2) AS DOUBLE) AS value, 'PKR' AS unit, 'DAILY' AS frequency, 'MARKET' AS source
FROM (SELECT CAST(ts AS DATE) AS d, max(value) - CASE WHEN day(CAST(ts AS DATE)) % 5 = 0 THEN 1000 ELSE 0 END AS c
      FROM events GROUP BY CAST(ts AS DATE)) WHERE c > 0""")
def g1(spark, sf):
    return mc.market_observations(quotes(spark, sf), "USD_PKR", 2, "PKR", "MARKET")


@query("g2_benchmark_rates", fx.sql(fx.MACRO, f"""
SELECT 'KIBOR_6M' AS indicator, observation_date, public_release_date, {sr('value + 0.65e0', 2)} AS value
FROM macro_raw WHERE indicator = 'SBP_POLICY_RATE'"""))
def g2(spark, sf):
    return mc.benchmark_rates(fx.macro_raw(spark, sf).filter("indicator = 'SBP_POLICY_RATE'")).select(
        "indicator", "observation_date", "public_release_date", r("value", 2).alias("value"))


@query("g3_release_table", """
WITH m AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS o, count(*)::DOUBLE AS yoy, count(DISTINCT o_custkey)::DOUBLE AS mom
           FROM orders GROUP BY 1)
SELECT 'CPI_YOY' AS indicator, o AS observation_date, CAST(o + INTERVAL 1 DAY AS DATE) AS public_release_date, yoy AS value FROM m
UNION ALL SELECT 'CPI_MOM', o, CAST(o + INTERVAL 1 DAY AS DATE), mom FROM m""")
def g3(spark, sf):
    wide = fx.table(spark, sf, "orders").groupBy(F.last_day(F.to_date("o_orderdate")).alias("observation_date")).agg(
        F.count(F.lit(1)).cast("double").alias("yoy"), F.countDistinct("o_custkey").cast("double").alias("mom"))
    return mc.release_table(wide.withColumn("public_release_date", F.date_add("observation_date", 1)),
                            {"yoy": "CPI_YOY", "mom": "CPI_MOM"})


@query("g4_raw_persist_dedupe", """
SELECT o_orderpriority AS indicator, last_day(CAST(o_orderdate AS DATE)) AS observation_date,
       last_day(CAST(o_orderdate AS DATE)) AS public_release_date, o_totalprice AS value
FROM orders QUALIFY row_number() OVER (PARTITION BY 1, 2 ORDER BY o_orderkey DESC, o_totalprice DESC) = 1""".replace(
    "PARTITION BY 1, 2", "PARTITION BY o_orderpriority, last_day(CAST(o_orderdate AS DATE))"))
def g4(spark, sf):
    month = F.last_day(F.to_date("o_orderdate"))
    raw = fx.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("indicator"), month.alias("observation_date"), month.alias("public_release_date"),
        F.col("o_totalprice").alias("value"), F.col("o_orderkey").alias("ingest_seq"))
    return mc.dedupe_raw(raw, ["ingest_seq", "value"]).drop("ingest_seq")


SESS = fx.BARS + "," + fx.MACRO + "," + ss.days_sql("min(trade_date)", "max(trade_date)", "(SELECT trade_date FROM bars)") + """,
sess AS (SELECT day AS session_date FROM cal WHERE is_trading)"""


def macro_sessions(spark, sf):
    from marketloom.functions.calendar import trading_days
    return trading_days(ss.bars_calendar(spark, sf))


@query("g5_asof_releases", fx.sql(SESS + """,
ind AS (SELECT DISTINCT indicator FROM macro_raw)""", """
SELECT i.indicator, s.session_date, m.value
FROM (SELECT * FROM sess CROSS JOIN ind) s JOIN ind i ON i.indicator = s.indicator
ASOF LEFT JOIN macro_raw m ON m.indicator = s.indicator AND s.session_date >= m.public_release_date"""))
def g5(spark, sf):
    return mc.point_in_time(fx.macro_raw(spark, sf), macro_sessions(spark, sf), list(fx.MACRO_NAMES.values())).drop("_known")


def _daily(fill: bool) -> str:
    def at(name: str) -> str:
        late = f"(SELECT min(public_release_date) FROM macro_raw WHERE indicator = '{name}')"
        val = f"(SELECT arg_max(value, public_release_date) FROM macro_raw m WHERE indicator = '{name}' AND m.public_release_date <= {{}})"
        got = val.format("s.session_date")
        if not fill:
            return got
        first = f"(SELECT min(session_date) FROM sess WHERE session_date >= {late})"
        return f"coalesce({got}, {val.format(first)})"
    cols = ", ".join(f"{at(i)} AS {c}" for c, i, _ in mc.SERIES if i != "KIBOR_6M")
    lag = "lag({0}) OVER (ORDER BY session_date)"
    ch = ", ".join(f"coalesce(CAST(round_even({c} / {lag.format(c)} - 1, 5) AS DOUBLE), 0e0) + 0e0 AS {n}" for c, n in mc.RETURNS.items())
    return f"""
mdaily AS (SELECT *, {ch} FROM (SELECT session_date, 10.65e0 AS kibor_6m, {cols} FROM sess s))"""


@query("g6_pivot_with_defaults", fx.sql(SESS + "," + _daily(False), """
SELECT session_date, usd_pkr, sbp_policy_rate, kibor_6m, cpi_yoy, brent_crude, kse100_index FROM mdaily"""))
def g6(spark, sf):
    return mc.macro_daily(fx.macro_raw(spark, sf), macro_sessions(spark, sf)).select(
        "session_date", *[c for c, _, _ in mc.SERIES])


@query("g7_series_changes", fx.sql(SESS + "," + _daily(True), "SELECT * FROM mdaily"))
def g7(spark, sf):
    return mc.macro_daily(fx.macro_raw(spark, sf), macro_sessions(spark, sf), backfill_leading=True).withColumns(
        {n: F.col(n) + 0.0 for n in mc.RETURNS.values()})


@query("g8_update_summary", fx.sql(SESS + "," + _daily(False), """
SELECT (SELECT count(*) FROM macro_raw) AS points, (SELECT string_agg(indicator, ',' ORDER BY indicator) FROM (SELECT DISTINCT indicator FROM macro_raw)) AS indicators,
       count(*) AS sessions, min(session_date) AS first_session, max(session_date) AS last_session,
       """ + ", ".join(f"arg_max({c}, session_date) AS latest_{c}" for c, _, _ in mc.SERIES) + " FROM mdaily"))
def g8(spark, sf):
    raw = fx.macro_raw(spark, sf)
    return mc.macro_summary(raw, mc.macro_daily(raw, macro_sessions(spark, sf))).withColumn(
        "indicators", F.array_join("indicators", ","))


# -- H ----------------------------------------------------------------------------


def dated_news(spark, sf):
    """News features moved onto the bar dates: session dates shifted back by 26 years of days."""
    return ss.news_table(spark, sf).withColumn("session_date", F.date_add("session_date", -9131))


H_NEWS = """,
hnews AS (SELECT * REPLACE (CAST(session_date - INTERVAL 9131 DAY AS DATE) AS session_date) FROM news)"""
NEWS_CTES = ss.NEWS.replace("days AS", "ndays AS").replace("FROM days", "FROM ndays").replace(
    "cal AS (", "ncal AS (", 1).replace("caln AS", "ncaln AS").replace("FROM cal)", "FROM ncal)").replace(
    "caln USING", "ncaln USING").replace("FROM caln", "FROM ncaln").replace("nncaln", "ncaln")
NEWS_CTES = NEWS_CTES.replace("sess AS", "nsess AS").replace("FROM sess", "FROM nsess").replace("JOIN sess", "JOIN nsess")


@query("h1_merge_news", fx.sql(fx.BARS + "," + NEWS_CTES + H_NEWS,
    "SELECT b.symbol, b.trade_date AS session_date, " + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ft.NEWS_FEATURES)
    + " FROM bars b LEFT JOIN hnews n ON n.symbol = b.symbol AND n.session_date = b.trade_date"))
def h1(spark, sf):
    return ft.merge_news(fx.bars(spark, sf), dated_news(spark, sf)).select("symbol", "session_date", *ft.NEWS_FEATURES)


H_MACRO = SESS + "," + _daily(False)
ASOF_MACRO = "bars b ASOF LEFT JOIN mdaily m ON b.trade_date >= m.session_date"
MACRO_COLS = ", ".join(f"coalesce(m.{c}, 0) AS {c}" for c in mc.MACRO_FEATURES)


def macro_table(spark, sf):
    return mc.macro_daily(fx.macro_raw(spark, sf), macro_sessions(spark, sf))


@query("h2_asof_merge_macro", fx.sql(H_MACRO, f"SELECT b.symbol, b.trade_date AS session_date, {MACRO_COLS} FROM {ASOF_MACRO}"))
def h2(spark, sf):
    base = fx.bars(spark, sf).withColumn("session_date", F.col("trade_date"))
    return ft.merge_macro(base, macro_table(spark, sf)).select("symbol", "session_date", *[
        (F.col(c) + 0.0).alias(c) for c in ft.MACRO_FEATURES])


@query("h3_interaction_features", fx.sql(H_MACRO + f""",
j AS (SELECT b.symbol, b.trade_date AS session_date, ln(b.close / lag(b.close) OVER (PARTITION BY b.symbol ORDER BY b.trade_date)) AS r1, {MACRO_COLS}
      FROM {ASOF_MACRO})""", f"""
SELECT symbol, session_date, {sr('coalesce(r1 - kse100_return_1d, 0)')} AS rel_kse100_ret_1d,
       {sr('kibor_6m - sbp_policy_rate')} AS policy_rate_spread, {sr('sbp_policy_rate - cpi_yoy')} AS real_interest_rate FROM j"""))
def h3(spark, sf):
    from marketloom.functions.indicators import log_return
    base = fx.bars(spark, sf).withColumn("return_1d", log_return(F.col("close"), 1)).withColumn("session_date", F.col("trade_date"))
    return ft.interactions(ft.merge_macro(base, macro_table(spark, sf))).select(
        "symbol", "session_date", *[r(c).alias(c) for c in ft.INTERACTIONS])


@query("h4_modal_fallback", fx.sql(fx.BARS, "SELECT symbol, trade_date, " + ", ".join(
    f"0e0 AS {c}" for c in [*ft.NEWS_FEATURES, *ft.MACRO_FEATURES]) + " FROM bars"))
def h4(spark, sf):
    return ft.merge_macro(ft.merge_news(fx.bars(spark, sf), None), None).select(
        "symbol", "trade_date", *ft.NEWS_FEATURES, *ft.MACRO_FEATURES)


def merged(spark, sf):
    return ft.merge_all(ft.build_features(fx.bars(spark, sf)), dated_news(spark, sf), macro_table(spark, sf))


@query("h5_merge_report", fx.sql(fx.BARS, """
SELECT symbol, 'SUCCESS' AS status, count(*) AS records, 44 AS technical_columns, 9 AS news_columns, 9 AS macro_columns,
       3 AS interaction_columns, min(trade_date) AS first_session, max(trade_date) AS last_session FROM bars GROUP BY symbol"""))
def h5(spark, sf):
    return ft.merge_report(fx.universe(spark, sf), merged(spark, sf))


def _combined_sql() -> str:
    """The feature matrix of C15 joined with the news, macro and interaction columns."""
    shown = ", ".join(f"{e} AS {c}" for c, e in {**ci.WINDOWED, **ci.VOLATILITY, **ci.OBV, **ci.TARGETS}.items())
    rec = ", ".join(f"{e} AS {c}" for c, e in ci.RECURSIVE.items())
    ctes = (
        ci.EWM + ci.R1 + SESS.removeprefix(fx.BARS) + "," + _daily(False) + "," + NEWS_CTES + H_NEWS + f""",
tech AS (SELECT * FROM (SELECT symbol, trade_date, open, high, low, close, volume, r1, {shown} FROM r)
         JOIN (SELECT symbol, trade_date, {rec} FROM rec) USING (symbol, trade_date)),
mac AS (SELECT b.symbol, b.trade_date, {MACRO_COLS} FROM {ASOF_MACRO})"""
    )
    news = ", ".join(f"coalesce(n.{c}, 0)::DOUBLE AS {c}" for c in ft.NEWS_FEATURES)
    return fx.sql(ctes, f"""
SELECT t.* EXCLUDE (r1), t.trade_date AS session_date, {news}, mac.* EXCLUDE (symbol, trade_date),
       {sr('coalesce(t.r1 - mac.kse100_return_1d, 0)')} AS rel_kse100_ret_1d,
       {sr('mac.kibor_6m - mac.sbp_policy_rate')} AS policy_rate_spread, {sr('mac.sbp_policy_rate - mac.cpi_yoy')} AS real_interest_rate
FROM tech t LEFT JOIN hnews n ON n.symbol = t.symbol AND n.session_date = t.trade_date
JOIN mac ON mac.symbol = t.symbol AND mac.trade_date = t.trade_date""", recursive=True)


@query("h6_combined_features", _combined_sql())
def h6(spark, sf):
    df = merged(spark, sf)

    def shown(c: str):
        if c in ft.INTERACTIONS or c == "target_return_5d":
            return r(c).alias(c)
        if c in ft.MACRO_FEATURES:
            return (F.col(c) + 0.0).alias(c)
        return r(c, PLACES.get(c, 6)).alias(c) if c in ft.TECHNICAL and c not in RAW else F.col(c)

    return df.select(*[shown(c) for c in df.columns])


@query("c16_feature_manifest", fx.sql(fx.BARS, """
SELECT symbol, count(*) AS records, 33 AS features, min(trade_date) AS first_date, max(trade_date) AS last_date, 'SUCCESS' AS status
FROM bars GROUP BY symbol"""))
def c16(spark, sf):
    return ft.feature_manifest(ft.build_features(fx.bars(spark, sf)))
