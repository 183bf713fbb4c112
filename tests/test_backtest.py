import random

import pytest
from pyspark.sql import functions as F

from marketloom.plans import backtest as bt
from marketloom.plans import split as sp

from helpers import day

DDL = "symbol string, strategy string, trade_date date, close double, is_upper_lock boolean, is_lower_lock boolean, signal double"


def _signals(spark, closes, signal, upper=(), lower=()):
    rows = [("AAA", "s", day(i), float(c), i in upper, i in lower, float(s)) for i, (c, s) in enumerate(zip(closes, signal, strict=True))]
    return spark.createDataFrame(rows, DDL)


def test_upper_lock_rejects_buy(spark):
    s = _signals(spark, [100, 107.5], [1, 1], upper={0})
    assert bt.rejections(s).count() == 1
    t = bt.trades(s).collect()
    assert [(r.side, r.trade_date) for r in t] == [("BUY", day(1))]


def test_lower_lock_delays_sell(spark):
    s = _signals(spark, [100, 92.5, 95], [1, 0, 0], lower={1})
    assert [r.side for r in bt.rejections(s).collect()] == ["SELL"]
    assert [(r.side, r.trade_date) for r in bt.trades(s).orderBy("trade_date").collect()] == [("BUY", day(0)), ("SELL", day(2))]


def test_round_trip_costs(spark):
    s = _signals(spark, [100, 100], [1, 0])
    t = bt.trades(s, cash=100_000.0).orderBy("trade_date").collect()
    assert bt.Costs().one_way == pytest.approx(0.00265)
    assert 100_000.0 - t[-1].cash_after == pytest.approx(sum(r.cost for r in t))


def _step(rows, cash):
    """Day-by-day account used to check the folded form."""
    c, shares, out = bt.Costs().one_way, 0, []
    for close, up, low, sig in rows:
        if sig > 0.5 and shares == 0 and not up:
            n = int(cash // (close * (1 + c)))
            cost = n * close + n * close * c
            if n > 0 and cost <= cash:
                cash, shares = cash - cost, n
        elif sig <= 0.5 and shares > 0 and not low:
            cash, shares = cash + shares * close - shares * close * c, 0
        out.append(cash + shares * close)
    return out


@pytest.mark.parametrize("cash", [1_000_000.0, 150.0])
def test_equity_matches_stepping(spark, cash):
    rng = random.Random(7)
    rows, p = [], 100.0
    for _ in range(200):
        p *= 1 + rng.uniform(-0.1, 0.1)
        rows.append((p, rng.random() < 0.1, rng.random() < 0.1, float(rng.random() < 0.5)))
    df = spark.createDataFrame([("AAA", "s", day(i), *r) for i, r in enumerate(rows)], DDL)
    got = [r.total_equity for r in bt.equity_curve(df, cash).orderBy("trade_date").collect()]
    assert got == pytest.approx(_step(rows, cash), rel=1e-12)


def test_metrics_identities(spark):
    n = 250
    equity = [100.0 * (1 + 0.25 * i / (n - 1)) for i in range(n)]
    m = bt.metrics(_signals(spark, equity, [1] * n)).first()
    assert m.sessions == n and m.total_trades == 0 and m.max_drawdown_days <= 1
    assert m.cagr == pytest.approx(m.total_return, rel=1e-9)
    flat = bt.metrics(_signals(spark, [100] * 30, [0] * 30)).first()
    assert (flat.total_return, flat.sharpe_ratio, flat.total_friction, flat.rejections) == (0.0, 0.0, 0.0, 0)


def test_downsampling_keeps_last(spark):
    curve = bt.equity_curve(_signals(spark, [100] * 450, [1] * 450))
    got = [r.trade_date for r in bt.downsample(curve).orderBy("trade_date").collect()]
    assert got[0] == day(0) and got[1] == day(2) and got[-1] == day(449)


def _folds(n, train, test, step, embargo, mode, least=15):
    out, k = [], 0
    while True:
        end = train + k * step
        start = end + embargo
        stop = min(start + test, n)
        if start >= n or stop - start < least:
            return out
        out.append((k, 0 if mode == "expanding" else k * step, end, start, stop))
        if stop >= n:
            return out
        k += 1


@pytest.mark.parametrize("args", [(700, 300, 50, 50, 5, "expanding"), (500, 200, 40, 40, 2, "rolling"), (640, 400, 60, 30, 5, "expanding"), (479, 400, 60, 60, 5, "expanding"), (481, 400, 60, 60, 5, "expanding")])
def test_folds_match_brute_force(spark, args):
    counts = spark.createDataFrame([("AAA", args[0])], "symbol string, n_rows bigint")
    got = sp.walk_forward_folds(counts, args[1], args[2], args[3], args[4], args[5]).orderBy("fold").collect()
    assert [(r.fold, r.train_start, r.train_end, r.test_start, r.test_end) for r in got] == _folds(*args)


def test_short_series_have_no_folds(spark):
    counts = spark.createDataFrame([("AAA", 419)], "symbol string, n_rows bigint")
    assert sp.walk_forward_folds(counts, 400, 60, 60, 5).count() == 0
    with pytest.raises(ValueError):
        sp.walk_forward_folds(counts, 0)


def test_split_is_chronological(spark):
    rows = [("AAA", day(i), float(i), 1.0 if i < 29 else None) for i in range(30)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, f double, target_next_day_dir double")
    out = sp.chronological_split(df, ["f"])
    got = {r.role: (r.n, r.lo, r.hi) for r in out.groupBy("role").agg(F.count("*").alias("n"), F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi")).collect()}
    assert got["train"] == (23, day(0), day(22)) and got["test"] == (6, day(23), day(28))
    with pytest.raises(ValueError):
        sp.chronological_split(df, ["f"], ratio=0.99)
