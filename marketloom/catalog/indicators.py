"""C (indicators) and D (targets) over the daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.registry import query, r, sr
from marketloom.functions import indicators as ind
from marketloom.functions import targets as tg
from marketloom.operators.windows import per_symbol, with_rolling_sums

W = "(PARTITION BY symbol ORDER BY trade_date)"


def _wn(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {_wn(n)} = {n} THEN {agg}({x}) OVER {_wn(n)} END"


def _lag(x: str, k: int) -> str:
    return f"lag({x}, {k}) OVER {W}"


def _body(cols: dict[str, str], src: str = "bars") -> str:
    return "SELECT symbol, trade_date, " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {src}"


# numbered bars, changes and true range, then one step per row
EWM = fx.BARS + f""",
num AS (
  SELECT symbol, trade_date, close, row_number() OVER {W} AS rn,
         close - {_lag('close', 1)} AS chg,
         greatest(high - low, abs(high - {_lag('close', 1)}), abs(low - {_lag('close', 1)})) AS tr
  FROM bars),
ewm AS (
  SELECT symbol, rn, close AS e12, close AS e26, 0e0 AS g, 0e0 AS l, tr AS atr, 0e0 AS sig
  FROM num WHERE rn = 1
  UNION ALL
  SELECT n.symbol, n.rn,
         e.e12 * (1 - 2e0/13) + n.close * 2e0/13,
         e.e26 * (1 - 2e0/27) + n.close * 2e0/27,
         CASE WHEN n.rn = 2 THEN greatest(n.chg, 0) ELSE e.g * (1 - 1e0/14) + greatest(n.chg, 0) / 14 END,
         CASE WHEN n.rn = 2 THEN greatest(-n.chg, 0) ELSE e.l * (1 - 1e0/14) + greatest(-n.chg, 0) / 14 END,
         e.atr * (1 - 1e0/14) + n.tr / 14,
         e.sig * 0.8e0 + 0.2e0 * ((e.e12 * (1 - 2e0/13) + n.close * 2e0/13)
                                  - (e.e26 * (1 - 2e0/27) + n.close * 2e0/27))
  FROM ewm e JOIN num n ON n.symbol = e.symbol AND n.rn = e.rn + 1),
rec AS (
  SELECT n.symbol, n.trade_date, e12, e26, e12 - e26 AS line, sig,
         CASE WHEN n.rn >= 15 THEN CASE WHEN l = 0 AND g > 0 THEN 1e2 WHEN l = 0 AND g = 0 THEN 5e1
              ELSE 100 - 100 / (1 + g / l) END END AS rsi,
         CASE WHEN n.rn >= 14 THEN atr END AS atr,
         CASE WHEN n.rn >= 14 THEN atr / n.close * 100 END AS atrp
  FROM ewm JOIN num n USING (symbol, rn))"""

RECURSIVE = {
    "ema_12": sr("e12", 4), "ema_26": sr("e26", 4), "rsi_14": sr("rsi", 4),
    "macd_line": sr("line", 4), "macd_signal": sr("sig", 4), "macd_hist": sr("line - sig", 4),
    "atr_14": sr("atr", 4), "atr_percent_14": sr("atrp", 4),
}
WINDOWED = {
    **{f"return_{k}d": sr(f"CASE WHEN close / {_lag('close', k)} > 0 THEN ln(close / {_lag('close', k)}) END")
       for k in ind.RETURN_LAGS},
    **{f"sma_{n}": _full("avg", "close", n) for n in ind.SMA_SPANS},  # exact on tick prices
    **{f"dist_sma_{n}": sr(f"(close - ({_full('avg', 'close', n)})) / ({_full('avg', 'close', n)})")
       for n in ind.SMA_SPANS},
    "roc_10": sr(f"(close - {_lag('close', 10)}) / nullif({_lag('close', 10)}, 0) * 100", 4),
    "bb_middle": _full("avg", "close", 20),
    "bb_upper": sr(f"({_full('avg', 'close', 20)}) + 2 * ({_full('stddev_samp', 'close', 20)})", 4),
    "bb_lower": sr(f"({_full('avg', 'close', 20)}) - 2 * ({_full('stddev_samp', 'close', 20)})", 4),
    "bb_bandwidth": sr(f"4 * ({_full('stddev_samp', 'close', 20)}) / nullif({_full('avg', 'close', 20)}, 0)"),
    "bb_percent_b": sr(
        f"(close - (({_full('avg', 'close', 20)}) - 2 * ({_full('stddev_samp', 'close', 20)})))"
        f" / nullif(4 * ({_full('stddev_samp', 'close', 20)}), 0)"),
    "volume_relative_20": sr(f"volume / nullif({_full('avg', 'volume', 20)}, 0)"),
    "volume_roc_5": sr(f"(volume - {_lag('volume', 5)}) / nullif({_lag('volume', 5)}, 0) * 100e0", 4),
}
VOLATILITY = {"volatility_20d": sr(_full("stddev_samp", "r1", 20) + " * sqrt(252)")}
OBV = {"obv": sr(f"sum(coalesce(sign(chg), 0) * volume) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING)", 2)}
R1 = f", r AS (SELECT *, ln(close / {_lag('close', 1)}) AS r1, close - {_lag('close', 1)} AS chg FROM bars)"
TARGETS = {
    "target_next_day_dir": f"CASE WHEN lead(close) OVER {W} IS NULL THEN NULL WHEN lead(close) OVER {W} > close THEN 1e0 ELSE 0e0 END",
    "target_next_day_3class": f"CASE WHEN lead(close) OVER {W} IS NULL THEN NULL"
    f" WHEN round(lead(close) OVER {W} / close - 1, 8) > 0.0075 THEN 1e0"
    f" WHEN round(lead(close) OVER {W} / close - 1, 8) < -0.0075 THEN -1e0 ELSE 0e0 END",
    "target_return_5d": sr(f"lead(close, 5) OVER {W} / close - 1"),
}
PLACES = {
    **{c: 4 for c in RECURSIVE},
    **{c: 4 for c in ("roc_10", "bb_upper", "bb_lower", "volume_roc_5")},
    "obv": 2,
}
RAW = {*(f"sma_{n}" for n in ind.SMA_SPANS), "bb_middle", "target_next_day_dir", "target_next_day_3class"}


def _pick(df, *names):
    return df.select("symbol", "trade_date", *[
        (F.col(c) if c in RAW else r(c, PLACES.get(c, 6))).alias(c)
        for c in names
    ])


def _sql(**cols: str) -> str:
    return fx.sql(fx.BARS, _body(cols))


def _windowed(*names: str) -> str:
    return _sql(**{c: WINDOWED[c] for c in names})


def _recursive(*names: str) -> str:
    return fx.sql(EWM, _body({c: RECURSIVE[c] for c in names}, "rec"), recursive=True)


def close():
    return F.col("close")


@query("c1_log_returns", _windowed(*[f"return_{k}d" for k in ind.RETURN_LAGS]))
def c1(spark, sf):
    df = fx.bars(spark, sf).withColumns({f"return_{k}d": ind.log_return(close(), k) for k in ind.RETURN_LAGS})
    return _pick(df, *[f"return_{k}d" for k in ind.RETURN_LAGS])


def _averages(spark, sf):
    df = with_rolling_sums(fx.bars(spark, sf), "close")
    return df.withColumns({f"sma_{n}": F.col(f"close_sum{n}") / n for n in ind.SMA_SPANS})


@query("c2_simple_moving_averages", _windowed(*[f"sma_{n}" for n in ind.SMA_SPANS]))
def c2(spark, sf):
    return _pick(_averages(spark, sf), *[f"sma_{n}" for n in ind.SMA_SPANS])


@query("c3_distance_to_sma", _windowed(*[f"dist_sma_{n}" for n in ind.SMA_SPANS]))
def c3(spark, sf):
    df = _averages(spark, sf)
    df = df.withColumns({f"dist_sma_{n}": ind.ratio(close() - F.col(f"sma_{n}"), F.col(f"sma_{n}")) for n in ind.SMA_SPANS})
    return _pick(df, *[f"dist_sma_{n}" for n in ind.SMA_SPANS])


@query("c4_ema", _recursive("ema_12", "ema_26"))
def c4(spark, sf):
    return _pick(ind.with_recursive(fx.bars(spark, sf)), "ema_12", "ema_26")


@query("c5_rsi_wilder", _recursive("rsi_14"))
def c5(spark, sf):
    return _pick(ind.with_recursive(fx.bars(spark, sf)), "rsi_14")


@query("c6_macd", _recursive("macd_line", "macd_signal", "macd_hist"))
def c6(spark, sf):
    return _pick(ind.with_recursive(fx.bars(spark, sf)), "macd_line", "macd_signal", "macd_hist")


@query("c7_rate_of_change", _windowed("roc_10"))
def c7(spark, sf):
    return _pick(fx.bars(spark, sf).withColumn("roc_10", ind.percent_change(close(), 10)), "roc_10")


@query("c8_volatility", fx.sql(fx.BARS + R1, _body(VOLATILITY, "r")))
def c8(spark, sf):
    df = fx.bars(spark, sf).withColumn("r1", ind.log_return(close(), 1))
    return _pick(df.withColumn("volatility_20d", ind.volatility(F.col("r1"))), "volatility_20d")


@query("c9_atr", _recursive("atr_14"))
def c9(spark, sf):
    return _pick(ind.with_recursive(fx.bars(spark, sf)), "atr_14")


@query("c10_atr_percent", _recursive("atr_percent_14"))
def c10(spark, sf):
    return _pick(ind.with_recursive(fx.bars(spark, sf)), "atr_percent_14")


BB = ("bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b")


@query("c11_bollinger_bands", _windowed(*BB))
def c11(spark, sf):
    return _pick(fx.bars(spark, sf).withColumns(ind.bollinger(close())), *BB)


@query("c12_relative_volume", _windowed("volume_relative_20"))
def c12(spark, sf):
    v = F.col("volume").cast("double")
    return _pick(fx.bars(spark, sf).withColumn("volume_relative_20", ind.ratio(v, ind.sma(v, 20))), "volume_relative_20")


@query("c13_on_balance_volume", fx.sql(fx.BARS + R1, _body(OBV, "r")))
def c13(spark, sf):
    df = fx.bars(spark, sf).withColumn("step", close() - F.lag(close(), 1).over(per_symbol()))
    return _pick(df.withColumn("obv", ind.on_balance_volume(F.col("step"), F.col("volume"))), "obv")


@query("c14_volume_rate_of_change", _windowed("volume_roc_5"))
def c14(spark, sf):
    v = F.col("volume").cast("double")
    return _pick(fx.bars(spark, sf).withColumn("volume_roc_5", ind.percent_change(v, 5)), "volume_roc_5")


def _matrix_sql() -> str:
    base = "SELECT symbol, trade_date, open, high, low, close, volume"
    win = ", ".join(f"{e} AS {c}" for c, e in {**WINDOWED, **VOLATILITY, **OBV, **TARGETS}.items())
    rec = ", ".join(f"{e} AS {c}" for c, e in RECURSIVE.items())
    return fx.sql(
        EWM + R1,
        f"SELECT * FROM ({base}, {win} FROM r) JOIN (SELECT symbol, trade_date, {rec} FROM rec) USING (symbol, trade_date)",
        recursive=True,
    )


@query("c15_feature_matrix", _matrix_sql())
def c15(spark, sf):
    df = tg.prediction_targets(ind.technical_features(fx.bars(spark, sf)))
    keep = ["symbol", "trade_date", "open", "high", "low", "close", "volume"]
    shown = [*ind.TECHNICAL, *TARGETS]
    return df.select(*keep, *[(F.col(c) if c in RAW else r(c, PLACES.get(c, 6))).alias(c) for c in shown])


@query("c17_chart_overlays", fx.sql(fx.BARS, _body({
    "sma_20": WINDOWED["sma_20"], "sma_50": WINDOWED["sma_50"],
    "bb_upper": WINDOWED["bb_upper"], "bb_lower": WINDOWED["bb_lower"],
    "bar_direction": "CASE WHEN close >= open THEN 'up' ELSE 'down' END"})))
def c17(spark, sf):
    df = ind.chart_overlays(fx.bars(spark, sf))
    return df.select("symbol", "trade_date", "sma_20", "sma_50",
                     r("bb_upper", 4).alias("bb_upper"), r("bb_lower", 4).alias("bb_lower"), "bar_direction")


@query("d1_next_day_direction", _sql(target_next_day_dir=TARGETS["target_next_day_dir"]))
def d1(spark, sf):
    return _pick(fx.bars(spark, sf).withColumn("target_next_day_dir", tg.next_day_direction(close())), "target_next_day_dir")


@query("d2_three_class", _sql(target_next_day_3class=TARGETS["target_next_day_3class"]))
def d2(spark, sf):
    return _pick(fx.bars(spark, sf).withColumn("target_next_day_3class", tg.next_day_3class(close())), "target_next_day_3class")


@query("d3_forward_return", _sql(target_return_5d=TARGETS["target_return_5d"]))
def d3(spark, sf):
    return _pick(fx.bars(spark, sf).withColumn("target_return_5d", tg.forward_return(close())), "target_return_5d")


@query("d4_target_bundle", _sql(**TARGETS))
def d4(spark, sf):
    return _pick(tg.prediction_targets(fx.bars(spark, sf)), *TARGETS)
