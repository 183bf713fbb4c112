"""B: validation, dedupe, adjustment, providers, quality and incremental merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.registry import query, r, sr
from marketloom.operators import clean as cl
from marketloom.operators import quality as ql
from marketloom.operators.dedupe import keep_first, keep_last, new_only

REASONS = """
checked AS (
  SELECT upper(trim(symbol)) AS symbol, trade_date, open, high, low, close, volume, dividend_amount,
         split_ratio, seq, feed_row,
         list_filter([
           CASE WHEN NOT regexp_full_match(upper(trim(symbol)), '[\\p{L}\\p{N}]+') THEN 'symbol' END,
           CASE WHEN open <= 0 THEN 'open_positive' END, CASE WHEN high <= 0 THEN 'high_positive' END,
           CASE WHEN low <= 0 THEN 'low_positive' END, CASE WHEN close <= 0 THEN 'close_positive' END,
           CASE WHEN volume < 0 THEN 'volume' END, CASE WHEN dividend_amount < 0 THEN 'dividend' END,
           CASE WHEN split_ratio <= 0 THEN 'split' END,
           CASE WHEN high < low - 1e-6 THEN 'high_below_low' END,
           CASE WHEN high < open - 1e-6 THEN 'high_below_open' END,
           CASE WHEN high < close - 1e-6 THEN 'high_below_close' END,
           CASE WHEN low > open + 1e-6 THEN 'low_above_open' END,
           CASE WHEN low > close + 1e-6 THEN 'low_above_close' END], lambda x: x IS NOT NULL) AS reasons
  FROM feed)"""
BARS_COLS = "symbol, trade_date, open, high, low, close, volume"


@query("b1_validation_outcome", fx.sql(fx.FEED + "," + REASONS, f"""
SELECT {BARS_COLS}, array_to_string(reasons, ',') AS reasons, feed_row FROM checked"""))
def b1(spark, sf):
    return cl.with_reasons(fx.raw_feed(spark, sf)).select(
        *BARS_COLS.split(", "), F.array_join("reasons", ",").alias("reasons"),
        (F.col("feed_order") * 8 + F.col("feed_line")).alias("feed_row"))


@query("b1_quarantine_counts", fx.sql(fx.FEED + "," + REASONS, """
SELECT reason, count(*) AS row_count FROM (SELECT unnest(reasons) AS reason FROM checked) GROUP BY reason"""))
def b1q(spark, sf):
    return cl.quarantine(fx.raw_feed(spark, sf)).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("row_count"))


VALID = fx.FEED + "," + REASONS + """,
valid AS (
  SELECT * EXCLUDE (reasons) FROM checked WHERE len(reasons) = 0
  QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY seq DESC) = 1)"""


@query("b2_dedupe_keep_last", fx.sql(VALID, f"SELECT {BARS_COLS} FROM valid"))
def b2(spark, sf):
    return cl.validate_prices(fx.raw_feed(spark, sf), fx.FEED_SEQ).select(*BARS_COLS.split(", "))


def provider_bars(spark, sf):
    """Bars offered by three providers; the first lacks some symbols and the years before 1997."""
    t = fx.ticks(spark, sf).withColumn("priority", F.pmod("l_suppkey", F.lit(3)))
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    t = t.filter((F.col("priority") != 0) | ((number % 4 != 0) & (F.year("trade_date") >= 1997)))
    return t.groupBy("symbol", "trade_date", "priority").agg(
        F.max("price").alias("close"), F.sum("l_quantity").cast("bigint").alias("volume"))


PROVIDERS = """
offers AS (
  SELECT upper(replace(p_brand, '#', '')) AS symbol, CAST(l_shipdate AS DATE) AS trade_date,
         l_suppkey % 3 AS priority, max(floor(l_extendedprice * 64e0 / l_quantity) / 64e0) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_suppkey % 3 <> 0 OR (CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 4 <> 0 AND year(l_shipdate) >= 1997)
  GROUP BY ALL)"""


@query("b3_dedupe_keep_first", fx.sql(PROVIDERS, """
SELECT * FROM offers QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY priority) = 1"""))
def b3(spark, sf):
    return keep_first(provider_bars(spark, sf), cl.KEY, ["priority"])


@query("b5_lock_flags", fx.sql(fx.ACTED, """
SELECT symbol, trade_date, close,
       coalesce((((close - p) / p >= 0.074) OR (close - p >= 0.99 AND close <= 15)) AND f, false) AS is_upper_lock,
       coalesce((((close - p) / p <= -0.074) OR (close - p <= -0.99 AND close <= 15)) AND f, false) AS is_lower_lock
FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p,
             abs(high - low) < close * 0.005e0 + 1e-4 AS f FROM bars)"""))
def b5(spark, sf):
    return cl.lock_flags(fx.bars(spark, sf)).select("symbol", "trade_date", "close", "is_upper_lock", "is_lower_lock")


ADJUSTED = fx.ACTED + """,
factors AS (
  SELECT *, CASE WHEN split_ratio > 0 AND abs(split_ratio - 1) > 1e-4 THEN 1 / split_ratio ELSE 1e0 END
         * CASE WHEN dividend_amount > 0 AND p > 0 THEN greatest(1 - dividend_amount / p, 1e-4) ELSE 1e0 END AS f
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM acted)),
adjusted AS (
  SELECT symbol, trade_date, open, high, low, close, volume, dividend_amount, split_ratio,
         CAST(round_even(close * coalesce(product(f) OVER (PARTITION BY symbol ORDER BY trade_date
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1e0), 4) AS DOUBLE) AS adjusted_close
  FROM factors)"""


@query("b6_back_adjusted_close", fx.sql(ADJUSTED, "SELECT symbol, trade_date, close, adjusted_close FROM adjusted"))
def b6(spark, sf):
    return cl.adjust_close(fx.bars_acted(spark, sf)).select("symbol", "trade_date", "close", "adjusted_close")


def half_acted(spark, sf):
    """Actions only for symbols with an even number; everyone carries a provider value."""
    even = F.regexp_extract("symbol", r"(\d+)", 1).cast("int") % 2 == 0
    df = fx.bars_acted(spark, sf)
    return df.withColumns({
        "dividend_amount": F.when(even, F.col("dividend_amount")).otherwise(0.0),
        "split_ratio": F.when(even, F.col("split_ratio")).otherwise(1.0),
        "adjusted_close": F.col("close") * 0.5,
    })


@query("b7_conditional_adjustment", fx.sql(ADJUSTED, """
SELECT symbol, trade_date, CASE WHEN CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % 2 = 0
       AND bool_or(dividend_amount > 0 OR split_ratio <> 1) OVER (PARTITION BY symbol)
       THEN adjusted_close ELSE close * 0.5e0 END AS adjusted_close FROM adjusted"""))
def b7(spark, sf):
    return cl.adjust_where_needed(half_acted(spark, sf)).select("symbol", "trade_date", "adjusted_close")


CHOSEN = PROVIDERS + """,
chosen AS (SELECT * FROM offers QUALIFY priority = min(priority) OVER (PARTITION BY symbol))"""


@query("b8_provider_failover", fx.sql(CHOSEN, "SELECT * FROM chosen"))
def b8(spark, sf):
    return cl.failover(provider_bars(spark, sf))


@query("b9_boundary_backfill", fx.sql(CHOSEN + """,
bound AS (SELECT symbol, min(priority) AS used, min(trade_date) AS lo, max(trade_date) AS hi FROM chosen GROUP BY symbol
          HAVING lo - DATE '1995-01-01' > 5 OR DATE '2001-12-01' - hi > 5),
extra AS (SELECT o.* FROM offers o JOIN bound b ON o.symbol = b.symbol AND o.priority > b.used
          QUALIFY o.priority = min(o.priority) OVER (PARTITION BY o.symbol)),
allrows AS (SELECT * FROM chosen UNION ALL SELECT * FROM extra)""", """
SELECT * FROM allrows QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY priority) = 1"""))
def b9(spark, sf):
    offers = provider_bars(spark, sf)
    return cl.backfill_bounds(cl.failover(offers), offers, F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"))


@query("b10_bootstrap_metrics", fx.sql(VALID, """
SELECT symbol, count(*) AS records, min(trade_date) AS first_date, max(trade_date) AS last_date,
       0::BIGINT AS upper_locks, 0::BIGINT AS lower_locks, 0::BIGINT AS dividends, 0::BIGINT AS splits
FROM valid WHERE symbol <> 'BRAND1' GROUP BY symbol"""))
def b10(spark, sf):
    stored = fx.universe(spark, sf).filter("symbol = 'BRAND1'")
    return cl.load_metrics(cl.bootstrap(fx.raw_feed(spark, sf), fx.FEED_SEQ, stored))


def stored_and_delta(spark, sf):
    """History up to mid-2000 for all but one symbol; the delta repeats two months and goes on."""
    whole = cl.lock_flags(fx.bars_acted(spark, sf)).withColumn("adjusted_close", F.col("close"))
    stored = whole.filter("trade_date < DATE'2000-07-01' AND symbol <> 'BRAND7'")
    delta = whole.filter("trade_date >= DATE'2000-05-01' AND symbol <> 'BRAND9'")
    return stored, delta


@query("b11_incremental_upsert", fx.sql(ADJUSTED, """
SELECT symbol, trade_date, close, adjusted_close FROM adjusted
WHERE symbol <> 'BRAND9' AND symbol <> 'BRAND7'
UNION ALL
SELECT symbol, trade_date, close, adjusted_close FROM adjusted WHERE symbol = 'BRAND7' AND trade_date >= DATE '2000-05-01'"""))
def b11(spark, sf):
    stored, delta = stored_and_delta(spark, sf)
    return cl.merge_increment(stored, delta).select("symbol", "trade_date", "close", "adjusted_close")


STATUS = fx.BARS + """,
st AS (
  SELECT symbol, CASE WHEN symbol = 'BRAND7' THEN 'BOOTSTRAPPED' WHEN symbol = 'BRAND9' THEN 'ALREADY_UP_TO_DATE'
              ELSE 'UPDATED' END AS status,
         CASE WHEN symbol <> 'BRAND7' THEN max(trade_date) FILTER (trade_date < DATE '2000-07-01') END AS previous_latest,
         CASE WHEN symbol = 'BRAND9' THEN max(trade_date) FILTER (trade_date < DATE '2000-07-01') ELSE max(trade_date) END AS new_latest,
         CASE WHEN symbol = 'BRAND9' THEN 0 WHEN symbol = 'BRAND7' THEN count(*) FILTER (trade_date >= DATE '2000-05-01')
              ELSE count(*) FILTER (trade_date >= DATE '2000-07-01') END AS records_added,
         CASE WHEN symbol = 'BRAND9' THEN count(*) FILTER (trade_date < DATE '2000-07-01')
              WHEN symbol = 'BRAND7' THEN count(*) FILTER (trade_date >= DATE '2000-05-01') ELSE count(*) END AS total_records
  FROM bars GROUP BY symbol)"""


def update_status(spark, sf):
    stored, delta = stored_and_delta(spark, sf)
    return cl.update_status(fx.universe(spark, sf), stored, cl.merge_increment(stored, delta))


@query("b11_update_status", fx.sql(STATUS, "SELECT * FROM st"))
def b11s(spark, sf):
    return update_status(spark, sf)


@query("b12_update_summary", fx.sql(STATUS, """
SELECT status, count(*) AS symbols, CAST(sum(records_added) AS BIGINT) AS records_added FROM st GROUP BY status"""))
def b12(spark, sf):
    return cl.update_summary(update_status(spark, sf))


GAPS = """
gaps AS (
  SELECT symbol, p AS gap_start, trade_date AS gap_end, CAST(trade_date - p AS INT) AS calendar_days,
         len(list_filter(range(1, trade_date - p), lambda k: isodow(p + CAST(k AS INT)) < 6))::BIGINT AS missing_weekdays
  FROM (SELECT *, lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM bars)
  WHERE trade_date - p > 4)"""


@query("b13_gap_detection", fx.sql(fx.ACTED + "," + GAPS, "SELECT * FROM gaps WHERE missing_weekdays >= 3"))
def b13(spark, sf):
    return ql.gaps(fx.bars(spark, sf))


REPORT = fx.ACTED + "," + GAPS + """,
g AS (SELECT symbol, count(*) AS gap_count, sum(missing_weekdays)::BIGINT AS gap_weekdays,
             count(*) FILTER (missing_weekdays >= 10) AS critical_gaps
      FROM gaps WHERE missing_weekdays >= 3 GROUP BY symbol),
base AS (
  SELECT symbol, count(*) AS sessions, min(trade_date) AS first_date, max(trade_date) AS last_date,
         count(*) FILTER (dividend_amount > 0) AS dividend_events, sum(dividend_amount) AS total_dividends,
         count(*) FILTER (split_ratio <> 1) AS split_events, count(*) FILTER (volume = 0) AS zero_volume_sessions
  FROM acted GROUP BY symbol),
rep AS (
  SELECT base.*, coalesce(gap_count, 0) AS gap_count, coalesce(gap_weekdays, 0) AS gap_weekdays,
         coalesce(critical_gaps, 0) AS critical_gaps, CAST(last_date - first_date + 1 AS INT) AS span_days,
         len(list_filter(range(0, last_date - first_date + 1), lambda k: isodow(first_date + CAST(k AS INT)) < 6))::BIGINT AS expected_weekdays
  FROM base LEFT JOIN g USING (symbol)),
report AS (
  SELECT *, sessions / greatest(expected_weekdays, 1) AS coverage,
         CASE WHEN sessions < 10 OR critical_gaps >= 2 OR sessions / greatest(expected_weekdays, 1) < 0.60 THEN 'CRITICAL'
              WHEN gap_count > 0 OR sessions / greatest(expected_weekdays, 1) < 0.85 THEN 'WARNING' ELSE 'HEALTHY' END AS health
  FROM rep)"""


def report(spark, sf):
    return ql.quality_report(cl.lock_flags(fx.bars_acted(spark, sf)))


@query("b14_quality_report", fx.sql(REPORT, f"SELECT * EXCLUDE (coverage), {sr('coverage')} AS coverage FROM report"))
def b14(spark, sf):
    return report(spark, sf).withColumn("coverage", r("coverage")).drop("upper_locks", "lower_locks")


@query("b15_quality_rollup", fx.sql(REPORT, """
SELECT count(*) AS symbols, count(*) FILTER (health = 'HEALTHY') AS healthy, count(*) FILTER (health = 'WARNING') AS warning,
       count(*) FILTER (health = 'CRITICAL') AS critical, sum(sessions)::BIGINT AS total_sessions FROM report"""))
def b15(spark, sf):
    return ql.quality_rollup(report(spark, sf))


@query("b16_corporate_actions", fx.sql(fx.ACTED, """
SELECT symbol, 'DIVIDEND' AS action_type, trade_date AS ex_date, dividend_amount AS value FROM acted WHERE dividend_amount > 0
UNION ALL SELECT symbol, 'SPLIT', trade_date, split_ratio FROM acted WHERE split_ratio <> 1"""))
def b16(spark, sf):
    return cl.action_events(fx.bars_acted(spark, sf))


@query("c18_lock_streak", fx.sql(fx.BARS, """
SELECT symbol, trade_date, CASE WHEN locked THEN row_number() OVER (PARTITION BY symbol, isl, locked ORDER BY trade_date) ELSE 0 END AS lock_streak
FROM (SELECT *, sum(CASE WHEN locked THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS isl
      FROM (SELECT symbol, trade_date, high = low AS locked FROM bars))"""))
def c18(spark, sf):
    from marketloom.functions.indicators import lock_streak
    flagged = fx.bars(spark, sf).withColumns({"is_upper_lock": F.col("high") == F.col("low"), "is_lower_lock": F.lit(False)})
    return lock_streak(flagged).select("symbol", "trade_date", "lock_streak")


@query("f6_skip_known_ids", """
SELECT user_id * 1000 + event_id % 40 AS item_id, max(ts) AS last_seen FROM events
WHERE event_type <> 'signup' AND user_id * 1000 + event_id % 40 NOT IN
  (SELECT user_id * 1000 + event_id % 40 FROM events WHERE event_type = 'signup') GROUP BY 1""")
def f6(spark, sf):
    ev = fx.table(spark, sf, "events").withColumn("item_id", F.col("user_id") * 1000 + F.col("event_id") % 40)
    stored = ev.filter("event_type = 'signup'").select("item_id")
    batch = ev.filter("event_type <> 'signup'").select("item_id", F.col("ts").alias("last_seen"))
    return keep_last(new_only(batch, stored, ["item_id"]), ["item_id"], ["last_seen"])
