"""Technical indicators as window columns over (symbol, trade_date).

P is adjusted_close where present, else close. Nothing looks past the current row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.windows import Ewm, full_window, per_symbol, running, with_ewm, with_rolling_sums
from marketloom.schemas import price_column

RETURN_LAGS = (1, 3, 5, 10, 20)
SMA_SPANS = (5, 10, 20, 50, 200)
EMA_SPANS = (12, 26)
SIGNAL_SPAN = 9
WILDER = 14
SESSIONS_PER_YEAR = 252

TECHNICAL = (
    [f"return_{k}d" for k in RETURN_LAGS]
    + [name for n in SMA_SPANS for name in (f"sma_{n}", f"dist_sma_{n}")]
    + [f"ema_{n}" for n in EMA_SPANS]
    + ["rsi_14", "macd_line", "macd_signal", "macd_hist", "roc_10", "volatility_20d"]
    + ["atr_14", "atr_percent_14"]
    + ["bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b"]
    + ["volume_relative_20", "obv", "volume_roc_5"]
)


def ratio(a: Column, b: Column) -> Column:
    """a / b with null on a zero divisor (ANSI mode would throw)."""
    return F.try_divide(a, b)


def log_return(p: Column, k: int) -> Column:
    r = ratio(p, F.lag(p, k).over(per_symbol()))
    return F.when(r > 0, F.ln(r))


def sma(p: Column, n: int) -> Column:
    return full_window(F.avg(p), p, n)


def percent_change(x: Column, k: int) -> Column:
    prev = F.lag(x, k).over(per_symbol())
    return ratio(x - prev, prev) * 100.0


def volatility(r1: Column, n: int = 20) -> Column:
    return full_window(F.stddev_samp(r1), r1, n) * math.sqrt(SESSIONS_PER_YEAR)


def true_range(high: Column, low: Column, close: Column) -> Column:
    prev = F.lag(close, 1).over(per_symbol())
    return F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))


def bands(p: Column, mid: Column, sd: Column, width: float = 2.0) -> dict[str, Column]:
    upper, lower = mid + width * sd, mid - width * sd
    return {
        "bb_middle": mid,
        "bb_upper": upper,
        "bb_lower": lower,
        "bb_bandwidth": ratio(upper - lower, mid),
        "bb_percent_b": ratio(p - lower, upper - lower),
    }


def bollinger(p: Column, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    return bands(p, sma(p, n), full_window(F.stddev_samp(p), p, n), width)


def on_balance_volume(p: Column, volume: Column) -> Column:
    """Running signed volume; takes a precomputed previous price column to stay one level deep."""
    return F.sum(F.coalesce(F.signum(p), F.lit(0.0)) * volume).over(running())


def rsi_from_means(gain: Column, loss: Column) -> Column:
    value = 100.0 - 100.0 / (1.0 + ratio(gain, loss))
    return (
        F.when((loss == 0) & (gain > 0), 100.0).when((loss == 0) & (gain == 0), 50.0).otherwise(value)
    )


def macd_signal_weights(span: int, signal: int = SIGNAL_SPAN) -> tuple[float, float]:
    """A mean of a mean as a weighted difference of two means of the input.

    Both recursions start in steady state at the first value, so the cascade of
    poles q1 and q2 splits into partial fractions:
    ewm_2(ewm_1(x)) = w1 * ewm_1(x) - w2 * ewm_2(x).
    """
    a1, a2 = 2.0 / (span + 1), 2.0 / (signal + 1)
    q1, q2 = 1.0 - a1, 1.0 - a2
    return a2 * q1 / (q1 - q2), a1 * q2 / (q1 - q2)


def recursive_series(p: Column, change: Column, tr: Column) -> list[Ewm]:
    """All recursive means the indicators need, to be run in one pass."""
    spans = [*EMA_SPANS, SIGNAL_SPAN]
    return [Ewm(f"ema_{n}", p, 2.0 / (n + 1)) for n in spans] + [
        Ewm("_avg_gain", F.greatest(change, F.lit(0.0)), 1.0 / WILDER, 1, WILDER),
        Ewm("_avg_loss", F.greatest(-change, F.lit(0.0)), 1.0 / WILDER, 1, WILDER),
        Ewm("atr_14", tr, 1.0 / WILDER, 0, WILDER),
    ]


def with_recursive(df: DataFrame) -> DataFrame:
    """EMA, RSI, MACD, ATR."""
    out = df.withColumn("_p", price_column(df).cast("double"))
    out = out.withColumns(
        {
            "_chg": F.col("_p") - F.lag("_p", 1).over(per_symbol()),
            "_tr": true_range(F.col("high"), F.col("low"), F.col("close")),
        }
    )
    out = with_ewm(out, recursive_series(F.col("_p"), F.col("_chg"), F.col("_tr")))
    fast, slow = EMA_SPANS
    wf, vf = macd_signal_weights(fast)
    ws, vs = macd_signal_weights(slow)
    fast_c, slow_c, sig_c = F.col(f"ema_{fast}"), F.col(f"ema_{slow}"), F.col(f"ema_{SIGNAL_SPAN}")
    out = out.withColumns(
        {
            "rsi_14": rsi_from_means(F.col("_avg_gain"), F.col("_avg_loss")),
            "macd_line": fast_c - slow_c,
            "macd_signal": (wf * fast_c - vf * sig_c) - (ws * slow_c - vs * sig_c),
            "atr_percent_14": ratio(F.col("atr_14"), F.col("close")) * 100.0,
        }
    ).withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
    return out.drop("_p", "_chg", "_tr", "_avg_gain", "_avg_loss", f"ema_{SIGNAL_SPAN}")


def with_windowed(df: DataFrame) -> DataFrame:
    """Returns, SMA, ROC, volatility, Bollinger and volume columns: one spec, one sort."""
    p, v, w = F.col("_p"), F.col("_v"), per_symbol()
    out = df.withColumns(
        {"_p": price_column(df).cast("double"), "_v": F.col("volume").cast("double")}
    )
    out = out.withColumns(
        {
            **{f"_r{k}": ratio(p, F.lag(p, k).over(w)) for k in RETURN_LAGS},
            "_step": p - F.lag(p, 1).over(w),
            "roc_10": percent_change(p, 10),
            "_sd": full_window(F.stddev_samp(p), p, 20),
            "volume_relative_20": ratio(v, sma(v, 20)),
            "volume_roc_5": percent_change(v, 5),
        }
    )
    out = out.withColumns({f"return_{k}d": F.when(F.col(f"_r{k}") > 0, F.ln(f"_r{k}")) for k in RETURN_LAGS})
    out = out.withColumns(
        {"volatility_20d": volatility(F.col("return_1d")), "obv": on_balance_volume(F.col("_step"), v)}
    )
    out = with_rolling_sums(out, "_p")
    out = out.withColumns({f"sma_{n}": F.col(f"_p_sum{n}") / n for n in SMA_SPANS})
    mid, sd = F.col("sma_20"), F.col("_sd")
    out = out.withColumns(
        {
            **{f"dist_sma_{n}": ratio(p - F.col(f"sma_{n}"), F.col(f"sma_{n}")) for n in SMA_SPANS},
            **bands(p, mid, sd),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def technical_features(df: DataFrame) -> DataFrame:
    """All 33 indicators appended to the input columns; one exchange on symbol.

    The recursive pass needs other sort orders, so it runs first, on narrow rows, and ends
    in the (symbol, trade_date) order that all the remaining windows share.
    """
    base = df.columns
    out = with_windowed(with_recursive(df))
    return out.select(*base, *TECHNICAL)


def chart_overlays(df: DataFrame) -> DataFrame:
    """SMA20/50 and Bollinger on the raw close, and the bar colour."""
    c = F.col("close").cast("double")
    bands = bollinger(c)
    return df.withColumns(
        {
            "sma_20": sma(c, 20),
            "sma_50": sma(c, 50),
            "bb_upper": bands["bb_upper"],
            "bb_lower": bands["bb_lower"],
            "bar_direction": F.when(F.col("close") >= F.col("open"), "up").otherwise("down"),
        }
    )


def lock_streak(df: DataFrame) -> DataFrame:
    """Length of the current run of locked sessions, 0 when the session is not locked."""
    locked = F.col("is_upper_lock") | F.col("is_lower_lock")
    marked = df.withColumn("_isl", F.sum(F.when(locked, 0).otherwise(1)).over(running()))
    return marked.withColumn(
        "lock_streak",
        F.when(
            locked,
            F.sum(F.when(locked, 1).otherwise(0)).over(
                running(per_symbol(keys=("symbol", "_isl")))
            ),
        ).otherwise(F.lit(0)),
    ).drop("_isl")
