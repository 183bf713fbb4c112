import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import clean as cl
from marketloom.operators import quality as ql
from marketloom.operators.dedupe import keep_first, keep_last
from marketloom.schemas import PRICES

from helpers import BAR_DDL, by_date, closes, day, walk


def _rows(spark, rows):
    return spark.createDataFrame(rows, BAR_DDL).withColumn("seq", F.monotonically_increasing_id())


def test_validation_rejects_broken_rows(spark):
    d = dt.date(2026, 1, 2)
    df = _rows(spark, [
        ("ok", d, 110.0, 115.0, 109.0, 112.0, 10),
        ("AAA", d, 115.0, 110.0, 114.0, 112.0, 10),
        ("AAB", d, 110.0, 115.0, 112.0, 113.0, 10),
        ("AAC", d, 0.0, 115.0, 109.0, 112.0, 10),
        ("A-D", d, 110.0, 115.0, 109.0, 112.0, 10),
        ("AAE", d, 110.0, 115.0, 109.0, 112.0, -1),
        ("AAF", d, None, 115.0, 109.0, 112.0, 1),
    ])
    assert [r.symbol for r in cl.valid_rows(df).collect()] == ["OK"]
    assert cl.quarantine(df).count() == 6


def test_all_rejected_raises_and_empty_is_typed(spark):
    bad = _rows(spark, [("AAA", dt.date(2026, 1, 2), 0.0, 1.0, 1.0, 1.0, 1)])
    with pytest.raises(ValueError):
        cl.require_rows(cl.valid_rows(bad), "nothing valid")
    assert cl.empty_prices(spark).schema == PRICES


def test_dedupe_keeps_last_by_order(spark):
    rows = [(1, "a", 1), (1, "b", 3), (1, "c", 2), (2, "d", 1)]
    df = spark.createDataFrame(rows, "k int, v string, seq int")
    assert {(r.k, r.v) for r in keep_last(df, ["k"], ["seq"]).collect()} == {(1, "b"), (2, "d")}
    assert {(r.k, r.v) for r in keep_first(df, ["k"], ["seq"]).collect()} == {(1, "a"), (2, "d")}


def test_dedupe_uses_partial_aggregation(spark):
    df = spark.createDataFrame([(1, "a", 1)], "k int, v string, seq int")
    plan = keep_last(df, ["k"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_lock_flags(spark):
    rows = [("AAA", day(0), 100.0, 102.0, 99.0, 100.0, 1), ("AAA", day(1), 107.5, 107.5, 107.5, 107.5, 1),
            ("AAA", day(2), 108.0, 110.0, 105.0, 108.0, 1), ("AAA", day(3), 99.9, 99.9, 99.9, 99.9, 1)]
    df = cl.lock_flags(spark.createDataFrame(rows, BAR_DDL))
    assert by_date(df, "is_upper_lock") == [False, True, False, False]
    assert by_date(df, "is_lower_lock") == [False, False, False, True]


def test_adjusted_close(spark):
    div = closes(spark, [100.0, 100.0, 95.0, 96.0], dividend_amount=[0.0, 0.0, 10.0, 0.0], split_ratio=[1.0] * 4)
    assert by_date(cl.adjust_close(div), "adjusted_close") == [90.0, 90.0, 95.0, 96.0]
    split = closes(spark, [200.0, 105.0, 110.0], dividend_amount=[0.0] * 3, split_ratio=[1.0, 2.0, 1.0])
    assert by_date(cl.adjust_close(split), "adjusted_close") == [100.0, 105.0, 110.0]


def test_adjustment_is_skipped_without_actions(spark):
    df = closes(spark, [10.0, 11.0], dividend_amount=[0.0, 0.0], split_ratio=[1.0, 1.0], adjusted_close=[7.0, 8.0])
    assert by_date(cl.adjust_where_needed(df), "adjusted_close") == [7.0, 8.0]


def _full(spark, rows):
    df = spark.createDataFrame(rows, BAR_DDL)
    extra = {"adjusted_close": F.col("close"), "dividend_amount": F.lit(0.0), "split_ratio": F.lit(1.0),
             "is_upper_lock": F.lit(False), "is_lower_lock": F.lit(False)}
    return df.withColumns(extra).select(*PRICES.fieldNames())


def test_incremental_merge_is_idempotent(spark):
    rows = walk(30, ("AAA", "BBB"))
    whole = _full(spark, rows)
    stored = whole.filter(F.col("trade_date") < day(20))
    first = cl.merge_increment(stored, whole)
    assert first.count() == 60
    assert cl.merge_increment(first, whole).count() == 0
    status = cl.update_status(whole.select("symbol").distinct(), stored, first)
    assert {(r.status, r.records_added) for r in status.collect()} == {("UPDATED", 10)}


def test_status_of_new_and_missing_symbols(spark):
    whole = _full(spark, walk(5, ("AAA", "BBB")))
    universe = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "symbol string")
    stored = whole.filter("symbol = 'AAA'")
    merged = cl.merge_increment(stored, whole.filter("symbol = 'BBB'"))
    got = {r.symbol: r.status for r in cl.update_status(universe, stored, merged).collect()}
    assert got == {"AAA": "ALREADY_UP_TO_DATE", "BBB": "BOOTSTRAPPED", "CCC": "FAILED"}


def test_gap_and_quality(spark):
    dates = ["2024-01-01", "2024-01-02", "2024-01-17", "2024-01-18", "2024-01-19"]
    rows = [("AAA", dt.date.fromisoformat(d), 1.0, 1.0, 1.0, 1.0, 1) for d in dates]
    gap = ql.gaps(spark.createDataFrame(rows, BAR_DDL)).collect()
    assert len(gap) == 1 and gap[0].calendar_days == 15 and gap[0].missing_weekdays == 10


def test_weekday_count_matches_brute_force(spark):
    pairs = [(day(i), day(i + j)) for i in range(9) for j in (0, 1, 5, 16, 40)]
    df = spark.createDataFrame(pairs, "a date, b date")
    for r in df.select("a", "b", ql.weekdays_between(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == sum((r.a + dt.timedelta(k)).weekday() < 5 for k in range((r.b - r.a).days))


def test_healthy_report(spark):
    days = [d for d in (dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(28)) if d.weekday() < 5]
    rows = [("AAA", d, 1.0, 1.0, 1.0, 1.0, 1, i == 1, i == 2, 5.5 if i == 3 else 0.0, 2.0 if i == 4 else 1.0) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, BAR_DDL + ", is_upper_lock boolean, is_lower_lock boolean, dividend_amount double, split_ratio double")
    r = ql.quality_report(df).first()
    assert (r.health, r.upper_locks, r.lower_locks, r.dividend_events, r.total_dividends, r.split_events) == ("HEALTHY", 1, 1, 1, 5.5, 1)


def test_failover_and_backfill(spark):
    rows = [("AAA", day(i), 1, 1.0) for i in range(10, 20)] + [("AAA", day(i), 2, 2.0) for i in range(0, 30)] + [("BBB", day(0), 2, 2.0)]
    offers = spark.createDataFrame(rows, "symbol string, trade_date date, priority int, close double")
    chosen = cl.failover(offers)
    assert chosen.filter("symbol = 'AAA'").count() == 10 and chosen.filter("symbol = 'BBB'").count() == 1
    filled = cl.backfill_bounds(chosen, offers, F.lit(day(0)), F.lit(day(29))).filter("symbol = 'AAA'")
    assert filled.count() == 30 and filled.filter("close = 1.0").count() == 10
