"""J: strategy signals, positions, trades, equity and metrics; I2/I3 folds and I1 split."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.indicators import _full
from marketloom.catalog.registry import query, r, sr
from marketloom.operators.clean import lock_flags
from marketloom.plans import backtest as bt
from marketloom.plans import split as sp

STRATEGIES = ("sma_crossover", "naive_persistence", "sma_fast", "price_over_sma20", "momentum", "buy_and_hold")


def locked_bars(spark, sf):
    """Bars with price-limit flags; every 13th day of month forces an upper, every 17th a lower lock."""
    day = F.dayofmonth("trade_date")
    df = lock_flags(fx.bars(spark, sf))
    return df.withColumns({"is_upper_lock": F.col("is_upper_lock") | (day == 13), "is_lower_lock": F.col("is_lower_lock") | (day == 17)})


def signals(spark, sf):
    return bt.strategy_signals(locked_bars(spark, sf))


COST = repr(bt.Costs().one_way)
SIG = fx.BARS + f""",
lb AS (
  SELECT symbol, trade_date, close,
         coalesce((((close - p) / p >= 0.074) OR (close - p >= 0.99 AND close <= 15)) AND f, false) OR day(trade_date) = 13 AS is_upper_lock,
         coalesce((((close - p) / p <= -0.074) OR (close - p <= -0.99 AND close <= 15)) AND f, false) OR day(trade_date) = 17 AS is_lower_lock,
         coalesce(close / p - 1, 0) AS ret, {_full('avg', 'close', 10)} AS m10, {_full('avg', 'close', 20)} AS m20,
         {_full('avg', 'close', 30)} AS m30, {_full('avg', 'close', 50)} AS m50
  FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p, abs(high - low) < close * 0.005e0 + 1e-4 AS f FROM bars)),
sig AS (
  SELECT symbol, s.strategy, trade_date, close, is_upper_lock, is_lower_lock, CASE WHEN s.t THEN 1e0 ELSE 0e0 END AS signal
  FROM (SELECT *, unnest([{{'strategy': 'sma_crossover', 't': m20 > m50}}, {{'strategy': 'naive_persistence', 't': ret > 0}},
    {{'strategy': 'sma_fast', 't': m10 > m30}}, {{'strategy': 'price_over_sma20', 't': close > m20}},
    {{'strategy': 'momentum', 't': ret > 0}}, {{'strategy': 'buy_and_hold', 't': true}}]) AS s FROM lb))"""
POS = SIG + """,
pos AS (
  SELECT *, lag(position, 1, 0) OVER (PARTITION BY symbol, strategy ORDER BY trade_date) AS previous_position
  FROM (SELECT *, coalesce(last_value(CASE WHEN signal > 0.5 AND NOT is_upper_lock THEN 1 WHEN signal <= 0.5 AND NOT is_lower_lock THEN 0 END IGNORE NULLS)
          OVER (PARTITION BY symbol, strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 0) AS position FROM sig))"""
# the account stepped day by day, independent of the fold used by the engine
SIM = POS + f""",
nsig AS (SELECT *, row_number() OVER (PARTITION BY symbol, strategy ORDER BY trade_date) AS rn FROM sig),
sim AS (
  SELECT symbol, strategy, 0::BIGINT AS rn, 1e6 AS cash, 0::BIGINT AS shares, NULL::VARCHAR AS side, 0::BIGINT AS qty, 0e0 AS cost, 0e0 AS net
  FROM nsig WHERE rn = 1
  UNION ALL
  SELECT symbol, strategy, rn,
         CASE WHEN b THEN cash - (w * close + w * close * {COST}e0) WHEN s THEN cash + (shares * close - shares * close * {COST}e0) ELSE cash END,
         CASE WHEN b THEN w WHEN s THEN 0 ELSE shares END,
         CASE WHEN b THEN 'BUY' WHEN s THEN 'SELL' END, CASE WHEN b THEN w WHEN s THEN shares ELSE 0 END,
         CASE WHEN b THEN w * close * {COST}e0 WHEN s THEN shares * close * {COST}e0 ELSE 0e0 END,
         CASE WHEN b THEN w * close + w * close * {COST}e0 WHEN s THEN shares * close - shares * close * {COST}e0 ELSE 0e0 END
  FROM (SELECT n.symbol, n.strategy, n.rn, n.close, p.cash, p.shares, w,
               p.shares = 0 AND n.signal > 0.5 AND NOT n.is_upper_lock AND w > 0 AND w * n.close + w * n.close * {COST}e0 <= p.cash AS b,
               p.shares > 0 AND n.signal <= 0.5 AND NOT n.is_lower_lock AS s
        FROM sim p JOIN nsig n ON n.symbol = p.symbol AND n.strategy = p.strategy AND n.rn = p.rn + 1,
             LATERAL (SELECT CAST(floor(p.cash / (n.close * (1 + {COST}e0))) AS BIGINT) AS w))),
book AS (SELECT s.*, n.trade_date, n.close, n.signal, n.is_upper_lock, n.is_lower_lock, s.cash + s.shares * n.close AS eq
         FROM sim s JOIN nsig n USING (symbol, strategy, rn)),
curve AS (
  SELECT *, (eq - peak) / peak AS dd FROM (
    SELECT *, coalesce(eq / lag(eq) OVER w - 1, 0) AS ret, eq / 1e6 - 1 AS cum, max(eq) OVER (w ROWS UNBOUNDED PRECEDING) AS peak,
           lag(shares, 1, 0::BIGINT) OVER w > 0 AS held
    FROM book WINDOW w AS (PARTITION BY symbol, strategy ORDER BY trade_date)))"""


@query("j1_strategy_signals", fx.sql(SIG, "SELECT symbol, strategy, trade_date, signal FROM sig"))
def j1(spark, sf):
    return signals(spark, sf).select("symbol", "strategy", "trade_date", "signal")


@query("j3_positions_with_locks", fx.sql(POS, "SELECT symbol, strategy, trade_date, position, previous_position FROM pos"))
def j3(spark, sf):
    return bt.positions(signals(spark, sf)).select("symbol", "strategy", "trade_date", "position", "previous_position")


@query("j4_rejections", fx.sql(POS, """
SELECT symbol, strategy, trade_date, CASE WHEN previous_position = 0 THEN 'BUY' ELSE 'SELL' END AS side, close AS price,
       CASE WHEN previous_position = 0 THEN 'UPPER_CIRCUIT_BREAKER_LOCK' ELSE 'LOWER_CIRCUIT_BREAKER_LOCK' END AS reason
FROM pos WHERE (previous_position = 0 AND signal > 0.5 AND is_upper_lock) OR (previous_position = 1 AND signal <= 0.5 AND is_lower_lock)"""))
def j4(spark, sf):
    return bt.rejections(signals(spark, sf))


@query("j5_trades", fx.sql(SIM, f"""
SELECT symbol, strategy, trade_date, side, qty AS shares, close AS price, cost, net AS net_value, cash AS cash_after
FROM book WHERE side IS NOT NULL""", recursive=True))
def j5(spark, sf):
    return bt.trades(signals(spark, sf)).select(
        "symbol", "strategy", "trade_date", "side", "shares", "price", "cost", "net_value", "cash_after")


@query("j6_equity_curve", fx.sql(SIM, f"""
SELECT symbol, strategy, trade_date, shares, cash, eq AS total_equity, {sr('ret', 8)} AS daily_return,
       {sr('cum')} AS cum_return, peak AS peak_equity, {sr('dd')} AS drawdown FROM curve""", recursive=True))
def j6(spark, sf):
    return bt.equity_curve(signals(spark, sf)).select(
        "symbol", "strategy", "trade_date", "shares", "cash", "total_equity",
        r("daily_return", 8).alias("daily_return"), r("cum_return").alias("cum_return"), "peak_equity", r("drawdown").alias("drawdown"))


RF = repr((1.0 + bt.RISK_FREE) ** (1.0 / 250) - 1.0)
TRIPS = """,
trips AS (SELECT symbol, strategy, trade_date, net - paid AS pnl FROM (
  SELECT *, lag(net) OVER (PARTITION BY symbol, strategy ORDER BY trade_date) AS paid FROM book WHERE side IS NOT NULL) WHERE side = 'SELL'),
stats AS (SELECT symbol, strategy, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, count(*) FILTER (pnl <= 0) AS losing_trades,
         count(*) FILTER (pnl > 0) / count(*) AS win_rate,
         CASE WHEN coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 0) > 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0))
              WHEN coalesce(sum(pnl) FILTER (pnl > 0), 0) > 0 THEN 99e0 ELSE 0e0 END AS profit_factor
  FROM trips GROUP BY ALL)"""
DUR = """,
dur AS (SELECT symbol, strategy, max(len) AS max_drawdown_days FROM (SELECT symbol, strategy, isl, count(*) FILTER (dd < 0) AS len FROM (
  SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS isl FROM curve) GROUP BY ALL) GROUP BY ALL)"""


@query("j7_performance_metrics", fx.sql(SIM + TRIPS + DUR, f"""
SELECT c.symbol, c.strategy, sessions, {sr('final_equity', 2)} AS final_equity, {sr('final_equity / 1e6 - 1')} AS total_return,
       {sr('CASE WHEN final_equity > 0 THEN pow(final_equity / 1e6, 250e0 / sessions) - 1 ELSE 0 END')} AS cagr, {sr('sd * sqrt(250)')} AS annualized_volatility,
       {sr('CASE WHEN sd > 1e-9 THEN ex / sd * sqrt(250) ELSE 0 END')} AS sharpe_ratio, {sr('CASE WHEN down > 1e-9 THEN ex / down * sqrt(250) ELSE 0 END')} AS sortino_ratio,
       {sr('max_drawdown')} AS max_drawdown, max_drawdown_days, coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades,
       coalesce(losing_trades, 0) AS losing_trades, {sr('coalesce(win_rate, 0)')} AS win_rate, {sr('coalesce(profit_factor, 0)')} AS profit_factor,
       {sr('total_friction', 2)} AS total_friction, rejections
FROM (SELECT symbol, strategy, count(*) AS sessions, arg_max(eq, trade_date) AS final_equity, stddev_pop(ret) AS sd, avg(ret - {RF}e0) AS ex,
             sqrt(avg(pow(least(ret - {RF}e0, 0), 2))) AS down, min(dd) AS max_drawdown, sum(cost) AS total_friction,
             count(*) FILTER ((NOT held AND signal > 0.5 AND is_upper_lock) OR (held AND signal <= 0.5 AND is_lower_lock)) AS rejections
      FROM curve GROUP BY ALL) c JOIN dur USING (symbol, strategy) LEFT JOIN stats USING (symbol, strategy)""", recursive=True))
def j7(spark, sf):
    m = bt.metrics(signals(spark, sf))
    six = ["total_return", "cagr", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "profit_factor"]
    return m.withColumns({**{c: r(c) for c in six}, "final_equity": r("final_equity", 2), "total_friction": r("total_friction", 2)})


@query("j8_drawdown_duration", fx.sql(SIM + DUR, "SELECT * FROM dur", recursive=True))
def j8(spark, sf):
    return bt.drawdown_duration(bt.equity_curve(signals(spark, sf)))


@query("j9_round_trip_pnl", fx.sql(SIM + TRIPS, f"""
SELECT symbol, strategy, total_trades, winning_trades, losing_trades, {sr('win_rate')} AS win_rate, {sr('profit_factor')} AS profit_factor FROM stats""", recursive=True))
def j9(spark, sf):
    return bt.trade_stats(bt.trades(signals(spark, sf))).withColumns({"win_rate": r("win_rate"), "profit_factor": r("profit_factor")})


@query("j10_benchmark_comparison", fx.sql(SIM, f"""
SELECT c.symbol, c.strategy, c.trade_date, c.eq AS total_equity, b.eq AS benchmark_equity, c.eq - b.eq + 0e0 AS excess_equity
FROM book c JOIN book b ON b.symbol = c.symbol AND b.trade_date = c.trade_date AND b.strategy = 'buy_and_hold'""", recursive=True))
def j10(spark, sf):
    return bt.against_benchmark(bt.equity_curve(signals(spark, sf)))


@query("j11_curve_downsampling", fx.sql(SIM, f"""
SELECT symbol, strategy, trade_date, eq AS total_equity FROM (SELECT *, max(rn) OVER (PARTITION BY symbol, strategy) AS n FROM book)
WHERE (rn - 1) % greatest(1, n // 200) = 0 OR rn = n""", recursive=True))
def j11(spark, sf):
    return bt.downsample(bt.equity_curve(signals(spark, sf))).select("symbol", "strategy", "trade_date", "total_equity")


# -- I1-I3 ------------------------------------------------------------------------

FEATURES = ["return_1d", "sma_20"]


def small_features(spark, sf):
    from marketloom.functions import indicators as ind
    from marketloom.functions import targets as tg
    c = F.col("close")
    return fx.bars(spark, sf).withColumns({
        "return_1d": ind.log_return(c, 1), "sma_20": ind.sma(c, 20), "target_next_day_dir": tg.next_day_direction(c)})


CLEAN = fx.BARS + f""",
feat AS (SELECT symbol, trade_date, close, lag(close) OVER w AS p, {_full('avg', 'close', 20)} AS sma_20, lead(close) OVER w AS nx
         FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
clean AS (SELECT symbol, trade_date, row_number() OVER (PARTITION BY symbol ORDER BY trade_date) - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n_rows,
                 CASE WHEN nx > close THEN 1e0 ELSE 0e0 END AS y
          FROM feat WHERE p IS NOT NULL AND sma_20 IS NOT NULL AND nx IS NOT NULL),
cnt AS (SELECT symbol, count(*) AS n_rows FROM clean GROUP BY symbol)"""


@query("i1_chronological_split", fx.sql(CLEAN, """
SELECT symbol, trade_date, row_no, n_rows, CASE WHEN row_no < floor(n_rows * 0.8e0) THEN 'train' ELSE 'test' END AS role FROM clean WHERE n_rows >= 20"""))
def i1(spark, sf):
    return sp.chronological_split(small_features(spark, sf), FEATURES).select("symbol", "trade_date", "row_no", "n_rows", "role")


def _folds_sql(mode: str) -> str:
    start = "0" if mode == "expanding" else "k * 60"
    return fx.sql(CLEAN, f"""
SELECT symbol, k::INT AS fold, ({start})::BIGINT AS train_start, 400 + k * 60 AS train_end, 405 + k * 60 AS test_start, least(465 + k * 60, n_rows) AS test_end
FROM cnt, LATERAL (SELECT unnest(range(0, 400)) AS k)
WHERE n_rows >= 420 AND 405 + k * 60 < n_rows AND least(465 + k * 60, n_rows) - (405 + k * 60) >= 15 AND (k = 0 OR 405 + k * 60 < n_rows)
  AND NOT (k > 0 AND 465 + (k - 1) * 60 >= n_rows)""")


@query("i2_walk_forward_folds", _folds_sql("expanding"))
def i2(spark, sf):
    counts = sp.row_counts(sp.numbered(small_features(spark, sf), [*FEATURES, "target_next_day_dir"]))
    return sp.walk_forward_folds(counts, 400, 60, 60, 5)


@query("i2_walk_forward_rolling", _folds_sql("rolling"))
def i2r(spark, sf):
    counts = sp.row_counts(sp.numbered(small_features(spark, sf), [*FEATURES, "target_next_day_dir"]))
    return sp.walk_forward_folds(counts, 400, 60, 60, 5, "rolling")


@query("i2_fold_membership", fx.sql(CLEAN + ",\nfolds AS (" + _folds_sql("expanding").split("\n", 1)[1].split("SELECT symbol, k::INT", 1)[1].join(["SELECT symbol, k::INT", ")"]), """
SELECT symbol, fold, CASE WHEN row_no < train_end THEN 'train' ELSE 'test' END AS role, count(*) AS row_count, min(trade_date) AS first_date, max(trade_date) AS last_date
FROM clean JOIN folds USING (symbol) WHERE row_no < train_end OR (row_no >= test_start AND row_no < test_end) GROUP BY ALL"""))
def i2m(spark, sf):
    rows = sp.numbered(small_features(spark, sf), [*FEATURES, "target_next_day_dir"])
    folds = sp.walk_forward_folds(sp.row_counts(rows), 400, 60, 60, 5)
    return sp.fold_rows(rows, folds).groupBy("symbol", "fold", "role").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


@query("i3_expanding_oof_folds", fx.sql(CLEAN, """
SELECT symbol, k::INT AS fold, 0::BIGINT AS train_start, f + k * size AS train_end, f + k * size AS test_start,
       CASE WHEN k = ks - 1 THEN n_rows ELSE f + (k + 1) * size END AS test_end
FROM (SELECT *, (n_rows - f) // ks AS size FROM (SELECT *, CASE WHEN n_rows - f < 4 THEN greatest(1, n_rows - f) ELSE 4 END AS ks
      FROM (SELECT symbol, n_rows, greatest(10, CAST(floor(n_rows * 0.4e0) AS BIGINT)) AS f FROM cnt WHERE n_rows >= 20))),
     LATERAL (SELECT unnest(range(0, ks)) AS k)"""))
def i3(spark, sf):
    return sp.expanding_oof_folds(sp.row_counts(sp.numbered(small_features(spark, sf), [*FEATURES, "target_next_day_dir"])))
