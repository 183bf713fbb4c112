import datetime as dt
import math

import pandas as pd
import pytest

from marketloom.functions import indicators as ind
from marketloom.functions import targets as tg
from marketloom.operators.windows import Ewm, with_ewm, with_rolling_sums
from pyspark.sql import functions as F

from helpers import BAR_DDL, by_date, closes, walk


def test_hand_values(spark):
    df = with_rolling_sums(closes(spark, [10.0, 20.0, 30.0, 40.0, 50.0]), "close")
    assert by_date(df, "close_sum5") == [None] * 4 + [150.0]
    sma3 = by_date(df.withColumn("x", ind.sma(F.col("close"), 3)), "x")
    assert sma3[:2] == [None, None] and sma3[2] == 20.0
    r = by_date(closes(spark, [100.0, 110.0]).withColumn("x", ind.log_return(F.col("close"), 1)), "x")
    assert r[0] is None and r[1] == pytest.approx(math.log(1.1))


def test_rsi_and_macd_extremes(spark):
    up = ind.with_recursive(closes(spark, [float(i) for i in range(1, 30)]))
    assert by_date(up, "rsi_14")[-1] == pytest.approx(100.0)
    flat = ind.with_recursive(closes(spark, [50.0] * 50))
    for c in ("macd_line", "macd_signal", "macd_hist"):
        assert by_date(flat, c)[-1] == pytest.approx(0.0, abs=1e-10)
    assert by_date(flat, "rsi_14")[-1] == 50.0


@pytest.mark.parametrize("block", [None, 16, 64])
def test_ewm_matches_pandas(spark, block):
    rows = walk(700)
    df = spark.createDataFrame(rows, BAR_DDL)
    series = [Ewm("a", F.col("close"), 2 / 13), Ewm("b", F.col("close"), 1 / 14, 0, 14), Ewm("c", F.col("close"), 0.2)]
    got = with_ewm(df, series, block=block).toPandas().sort_values(["symbol", "trade_date"])
    for _, g in got.groupby("symbol"):
        x = g["close"].reset_index(drop=True)
        for name, alpha, least in (("a", 2 / 13, 0), ("b", 1 / 14, 14), ("c", 0.2, 0)):
            want = x.ewm(alpha=alpha, adjust=False, min_periods=least).mean()
            pd.testing.assert_series_equal(g[name].reset_index(drop=True), want, check_names=False, rtol=1e-12)


def test_all_indicators_match_pandas(spark):
    df = spark.createDataFrame(walk(260, ("AAA",)), BAR_DDL)
    got = ind.technical_features(df).toPandas().sort_values("trade_date").reset_index(drop=True)
    p = got["close"]
    delta = p.diff()
    gain = delta.clip(lower=0).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    loss = (-delta.clip(upper=0)).ewm(alpha=1 / 14, min_periods=14, adjust=False).mean()
    macd = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    tr = pd.concat([got.high - got.low, (got.high - p.shift()).abs(), (got.low - p.shift()).abs()], axis=1).max(axis=1)
    want = {
        "sma_200": p.rolling(200).mean(),
        "sma_50": p.rolling(50).mean(),
        "rsi_14": 100 - 100 / (1 + gain / loss),
        "macd_signal": macd.ewm(span=9, adjust=False).mean(),
        "atr_14": tr.ewm(alpha=1 / 14, min_periods=14, adjust=False).mean(),
        "volatility_20d": (p / p.shift()).apply(math.log).rolling(20).std() * math.sqrt(252),
        "bb_upper": p.rolling(20).mean() + 2 * p.rolling(20).std(),
    }
    for name, series in want.items():
        pd.testing.assert_series_equal(got[name], series, check_names=False, rtol=1e-9)


def test_no_look_ahead(spark):
    rows = walk(240, ("AAA",))
    changed = rows[:-1] + [(*rows[-1][:2], *[v * 3.5 for v in rows[-1][2:6]], rows[-1][6])]
    a = ind.technical_features(spark.createDataFrame(rows, BAR_DDL)).toPandas().sort_values("trade_date")
    b = ind.technical_features(spark.createDataFrame(changed, BAR_DDL)).toPandas().sort_values("trade_date")
    pd.testing.assert_frame_equal(a.iloc[:-1][ind.TECHNICAL], b.iloc[:-1][ind.TECHNICAL], atol=1e-10)


def test_plan_has_one_exchange_and_no_python(spark, tmp_path):
    path = str(tmp_path / "bars")
    spark.createDataFrame(walk(50), BAR_DDL).write.parquet(path)
    plan = ind.technical_features(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_targets(spark):
    df = tg.prediction_targets(closes(spark, [100.0, 102.0, 101.0, 103.0, 103.0, 105.0]))
    assert by_date(df, "target_next_day_dir") == [1.0, 0.0, 1.0, 0.0, 1.0, None]
    assert by_date(df, "target_next_day_3class") == [1.0, -1.0, 1.0, 0.0, 1.0, None]
    fwd = by_date(df, "target_return_5d")
    assert fwd[0] == pytest.approx(0.05) and fwd[1:] == [None] * 5
    edge = by_date(tg.prediction_targets(closes(spark, [100.0, 100.75])), "target_next_day_3class")
    assert edge == [0.0, None]
    above = by_date(tg.prediction_targets(closes(spark, [100.0, 100.76])), "target_next_day_3class")
    assert above == [1.0, None]


def test_adjusted_close_is_used_when_present(spark):
    df = closes(spark, [10.0, 10.0], adjusted_close=[5.0, 10.0])
    r = by_date(ind.technical_features(df), "return_1d")
    assert r[1] == pytest.approx(math.log(2.0))


def test_lock_streak(spark):
    flags = [False, True, True, False, True]
    rows = [("AAA", dt.date(2024, 1, i + 1), f, False) for i, f in enumerate(flags)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, is_upper_lock boolean, is_lower_lock boolean")
    assert by_date(ind.lock_streak(df), "lock_streak") == [0, 1, 2, 0, 1]
