"""N: streaming forms, run to completion over the event and order tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.macro import SESS, macro_sessions
from marketloom.catalog.registry import query
from marketloom.session import shared_folder
from marketloom.sources.tables import read_version
from marketloom.streaming import streams as st


def _fresh(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    return st.read_files(spark, sf, fx.table(spark, sf, name).schema, f"{name}.parquet")


def events(spark, sf):
    """Event stream with prices and scores on a 1/64 grid."""
    return _stream(spark, sf, "events").select(
        "event_id", "user_id", F.upper("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(F.col("value") * 64.0) / 64.0 + 1.0).alias("price"))


EV = """
ev AS (SELECT event_id, user_id, upper(event_type) AS symbol, ts, floor(value * 64e0) / 64e0 + 1 AS price FROM events)"""


DAILY = fx.sql(EV, """
SELECT symbol, CAST(ts AS DATE) AS trade_date, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
       arg_max(price, (ts, event_id)) AS close, count(*) AS volume FROM ev GROUP BY ALL""")


def _ticks():
    return st.tick_partials("symbol", "ts", F.col("price"), F.lit(1), ["event_id"])


@query("n1_streaming_bar_upsert", DAILY)
def n1(spark, sf):
    """Bars merged from partials, then upserted: a symbol is written again only where its bars changed."""
    home = _fresh(spark)
    keep = st.keep_partials(f"{home}/partials", _ticks())

    def handle(batch, batch_id):
        keep(batch, batch_id)
        touched = batch.select("symbol").distinct()
        bars = st.merge_ticks(st.read_partials(spark, f"{home}/partials").join(touched, "symbol", "left_semi"))
        st.write_partitions(bars, f"{home}/prices")

    for attempt in ("a", "b"):  # a second run over the same files must change nothing
        st.run_batches(events(spark, sf), f"{home}/checkpoint_{attempt}", handle)
    return spark.read.parquet(f"{home}/prices").select("symbol", "trade_date", "open", "high", "low", "close", "volume")


@query("n2_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def n2(spark, sf):
    """A second run goes on from the checkpoint of the first and adds nothing."""
    home, keys = _fresh(spark), ["user_id", "event_type"]
    for _ in range(2):
        st.keep_first_seen(_stream(spark, sf, "events").select(*keys), keys, f"{home}/t", f"{home}/c")
    return spark.read.parquet(f"{home}/t").select(*keys)


def _windows(spark, sf, hours):
    home = _fresh(spark)
    make = st.news_windows(["symbol"], "ts", hours, F.col("price") - 250.0)
    st.run_batches(events(spark, sf), f"{home}/c", st.keep_partials(f"{home}/t", make))
    return st.merge_windows(st.read_partials(spark, f"{home}/t"), ["symbol"])


def _windows_sql(hours: int) -> str:
    return fx.sql(EV + """,
lim AS (SELECT max(ts) AS hi, min(ts) AS lo FROM ev),
opens AS (SELECT CAST(unnest(generate_series(date_trunc('day', lo), hi + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS DATE) + TIME '04:15:00' AS o FROM lim)""", f"""
SELECT symbol, CAST(o AS DATE) AS session_date, count(*) AS news_count, sum(price - 250) AS score_sum
FROM opens JOIN ev ON ts > o - INTERVAL {hours} HOUR AND ts <= o GROUP BY ALL""")


@query("n3_news_windows_24h", _windows_sql(24))
def n3(spark, sf):
    return _windows(spark, sf, 24)


@query("n3_news_windows_72h", _windows_sql(72))
def n3l(spark, sf):
    return _windows(spark, sf, 72)


@query("n4_tick_bars", DAILY)
def n4(spark, sf):
    home = _fresh(spark)
    st.run_batches(events(spark, sf), f"{home}/c", st.keep_partials(f"{home}/t", _ticks()))
    return st.merge_ticks(st.read_partials(spark, f"{home}/t"))


@query("n5_late_releases", fx.sql(SESS, """
SELECT s.session_date, u.value AS usd_pkr, b.value AS brent_crude FROM sess s
ASOF LEFT JOIN (SELECT * FROM macro_raw WHERE indicator = 'USD_PKR') u ON s.session_date >= u.public_release_date
ASOF LEFT JOIN (SELECT * FROM macro_raw WHERE indicator = 'BRENT_CRUDE') b ON s.session_date >= b.public_release_date"""))
def n5(spark, sf):
    """Sums and counts of a month are kept by batch; a month is divided when it is read."""
    home = _fresh(spark)
    keep = st.keep_partials(f"{home}/partials", fx.monthly_sums)
    release = st.late_releases(f"{home}/raw", f"{home}/daily", lambda: macro_sessions(spark, sf))

    def handle(batch, batch_id):
        keep(batch, batch_id)
        months = batch.select(F.last_day(F.to_date("o_orderdate")).alias("observation_date")).distinct()
        touched = st.read_partials(spark, f"{home}/partials").join(months, "observation_date", "left_semi")
        release(fx.monthly_means(touched), batch_id)

    st.run_batches(_stream(spark, sf, "orders"), f"{home}/checkpoint", handle)
    return read_version(spark, f"{home}/daily").select("session_date", "usd_pkr", "brent_crude")
