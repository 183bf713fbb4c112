import datetime as dt

from pyspark.sql import functions as F

from marketloom.functions import calendar as cal
from marketloom.operators.asof import asof_backward
from marketloom.plans import features as ft
from marketloom.plans import macro as mc

from helpers import BAR_DDL, day, walk

D = dt.date.fromisoformat


def _raw(spark, rows):
    return spark.createDataFrame(
        [(i, D(o), D(r), v) for i, o, r, v in rows],
        "indicator string, observation_date date, public_release_date date, value double",
    )


def _sessions(spark, a, b):
    return cal.trading_days(cal.Calendar().between(spark, a, b))


def test_release_rule(spark):
    raw = _raw(spark, [("CPI_YOY", "2023-12-31", "2024-01-01", 29.7), ("CPI_YOY", "2024-01-31", "2024-02-01", 28.3)])
    got = {str(r.session_date): r for r in mc.macro_daily(raw, _sessions(spark, "2024-01-01", "2024-02-10")).collect()}
    assert got["2024-01-15"].cpi_yoy == 29.7 and got["2024-01-31"].cpi_yoy == 29.7
    assert got["2024-02-01"].cpi_yoy == 28.3 and got["2024-02-02"].cpi_yoy == 28.3
    assert got["2024-01-15"].usd_pkr == 278.50 and got["2024-01-15"].usd_pkr_return_1d == 0.0


def test_leading_sessions_are_null_unless_asked(spark):
    raw = _raw(spark, [("USD_PKR", "2024-01-10", "2024-01-10", 280.0), ("USD_PKR", "2024-01-11", "2024-01-11", 281.0)])
    days = _sessions(spark, "2024-01-08", "2024-01-12")
    strict = [r.usd_pkr for r in mc.macro_daily(raw, days).orderBy("session_date").collect()]
    assert strict == [None, None, 280.0, 281.0, 281.0]
    filled = [r.usd_pkr for r in mc.macro_daily(raw, days, backfill_leading=True).orderBy("session_date").collect()]
    assert filled == [280.0, 280.0, 280.0, 281.0, 281.0]


def test_derived_series(spark):
    policy = _raw(spark, [("SBP_POLICY_RATE", "2024-01-01", "2024-01-01", 10.5)])
    r = mc.benchmark_rates(policy).first()
    assert (r.indicator, r.value) == ("KIBOR_6M", 11.15)


def test_asof_matches_brute_force(spark):
    left = [("a", i % 7) for i in range(40)] + [("b", i) for i in range(10)]
    right = [("a", 2, 1.0, 1), ("a", 5, 2.0, 1), ("a", 5, 3.0, 2), ("b", 4, 9.0, 1)]
    l_df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(left)], "k string, t int, i int")
    r_df = spark.createDataFrame(right, "k string, rt int, v double, seq int")
    got = {r.i: r.v for r in asof_backward(l_df, r_df, ["k"], "t", "rt", ["v"], ["seq"]).collect()}
    for i, (k, t) in enumerate(left):
        fits = [(rt, seq, v) for rk, rt, v, seq in right if rk == k and rt <= t]
        assert got[i] == (max(fits)[2] if fits else None)


def test_merge_uses_latest_macro_and_zero_news(spark):
    bars = spark.createDataFrame(walk(60, ("AAA",)), BAR_DDL)
    macro = spark.createDataFrame(
        [(day(0), *[20.0] * 9), (day(31), *[15.0] * 9)],
        "session_date date, " + ", ".join(f"{c} double" for c in mc.MACRO_FEATURES),
    )
    out = ft.merge_all(ft.build_features(bars), None, macro).orderBy("trade_date").collect()
    assert {r.cpi_yoy for r in out[:31]} == {20.0} and {r.cpi_yoy for r in out[31:]} == {15.0}
    assert all(r.news_count_24h == 0.0 for r in out)
    assert out[5].rel_kse100_ret_1d == out[5].return_1d - out[5].kse100_return_1d
    assert len(out) == 60


def test_report_marks_missing_symbols(spark):
    bars = spark.createDataFrame(walk(30, ("AAA",)), BAR_DDL)
    universe = spark.createDataFrame([("AAA",), ("ZZZ",)], "symbol string")
    got = {r.symbol: r.status for r in ft.merge_report(universe, ft.merge_all(ft.build_features(bars))).collect()}
    assert got == {"AAA": "SUCCESS", "ZZZ": "SKIPPED"}


def test_market_observations_drop_bad_prices(spark):
    q = spark.createDataFrame([(day(0), 278.456), (day(1), 0.0), (day(2), None)], "obs_date date, close double")
    got = mc.market_observations(q, "USD_PKR", 2, "PKR", "M").collect()
    assert [(r.value, r.public_release_date) for r in got] == [(278.46, day(0))]
    assert F.col("x") is not None
