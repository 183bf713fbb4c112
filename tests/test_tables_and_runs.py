import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.plans import daily as dl
from marketloom.plans import models as md
from marketloom.plans import registry as rg
from marketloom.schemas import PRICES
from marketloom.sources import commits as cm
from marketloom.sources import tables as tb
from marketloom.streaming import streams as st

from helpers import BAR_DDL, day, walk


def test_missing_dataset(spark, tmp_path):
    with pytest.raises(tb.DatasetNotFoundError):
        tb.read_table(spark, str(tmp_path / "none"))
    assert tb.read_or_empty(spark, str(tmp_path / "none"), PRICES).count() == 0


def test_partition_overwrite_keeps_other_symbols(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(walk(5, ("AAA", "BBB")), BAR_DDL)
    tb.write_partitions(df, path)
    tb.write_partitions(df.filter("symbol = 'AAA'").limit(2), path)
    got = {r.symbol: r["count"] for r in tb.read_table(spark, path).groupBy("symbol").count().collect()}
    assert got == {"AAA": 2, "BBB": 5}


def test_versions_switch_on_commit(spark, tmp_path):
    root = str(tmp_path / "v")
    tb.write_version(spark.range(3).toDF("id"), root)
    (tmp_path / "v" / "v000002").mkdir()  # an unfinished write: no _SUCCESS
    assert tb.read_version(spark, root).count() == 3
    tb.write_version(tb.read_version(spark, root).filter("id > 0"), root)
    assert tb.read_version(spark, root).count() == 2


def test_views_and_parameters(spark, tmp_path):
    layout = tb.Layout(str(tmp_path))
    tb.write_partitions(spark.createDataFrame(walk(4, ("AAA", "BBB")), BAR_DDL), layout.prices)
    assert tb.register_views(spark, layout) == ["prices"]
    assert tb.sql(spark, "SELECT count(*) AS n FROM prices WHERE symbol = :s", s="AAA").first().n == 4


def test_projection_and_filter_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.createDataFrame(walk(4), BAR_DDL).write.parquet(path)
    plan = tb.read_table(spark, path, ["symbol", "close"]).filter("close > 1")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<symbol:string,close:double>" in plan and "GreaterThan(close,1.0)" in plan


def test_universe(spark):
    u = tb.universe_table(spark, [{"symbol": "ogdc", "name": "Oil", "enabled": True}, {"symbol": "PPL", "enabled": False}])
    assert tb.find_instrument(u, "OgDc").first().name == "Oil"
    assert [r.symbol for r in tb.enabled_instruments(u).collect()] == ["OGDC"]
    with pytest.raises(ValueError):
        tb.universe_table(spark, [{"symbol": "A-B"}])


PAYLOADS = "source string, ingest_date string, symbol string, payload string"


def test_raw_landing_counts_committed_batches_only(spark, tmp_path):
    root = str(tmp_path / "raw")
    assert cm.landed(spark, root).count() == 0 and cm.verify(spark, root).count() == 0
    first = spark.createDataFrame([("dps", "2024-01-01", "AAA", "{}"), ("dps", "2024-01-01", "AAA", "{}"), (None, None, None, None)], PAYLOADS)
    assert cm.land(first, root, "b1") and not cm.land(first.limit(1), root, "b1")
    first.write.parquet(f"{root}/data/b2")  # a batch that broke off before its manifest
    assert cm.landed(spark, root).count() == 3
    got = {r.source: (r.payloads, r.bytes, r.intact) for r in cm.verify(spark, root).collect()}
    assert got == {"dps": (2, 4, True), None: (1, 0, True)}
    assert cm.land(first, root, "b2") and cm.read_verified(spark, root).count() == 6
    assert cm.land(first.limit(0), root, "b3") and cm.read_verified(spark, root).count() == 6


def test_damaged_batches_are_found(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = spark.createDataFrame([("dps", "2024-01-01", "AAA", "{1}"), ("dps", "2024-01-01", "AAA", "{2}")], PAYLOADS)
    cm.land(rows, root, "good")
    cm.land(rows, root, "bad")
    stored = spark.read.schema(cm.DATA).parquet(f"{root}/data/bad").withColumn("payload", F.regexp_replace("payload", "2", "3"))
    spark.createDataFrame(stored.collect(), cm.DATA).write.mode("overwrite").parquet(f"{root}/data/bad")
    assert {r.batch: r.intact for r in cm.verify(spark, root).collect()} == {"good": True, "bad": False}
    with pytest.raises(cm.ContentMismatchError, match="bad"):
        cm.read_verified(spark, root)


def test_views_of_versioned_layers_show_the_latest_version(spark, tmp_path):
    layout = tb.Layout(str(tmp_path))
    for n in (2, 5):
        tb.write_version(spark.range(n), layout.macro)
    assert tb.register_views(spark, layout) == ["macro"]
    assert spark.sql("SELECT count(*) AS n FROM macro").first().n == 5


def test_refused_predictions_are_kept_aside_once(spark, tmp_path):
    root = str(tmp_path / "rejects")
    assert tb.reject_counts(spark, root).count() == 0
    rows = [("a", 0.5, 0.1), ("b", 1.5, 0.1), ("c", None, 0.1), ("d", 0.5, None), ("e", float("nan"), 0.1), ("f", 0.0, -0.1), ("g", 1.0, 1.0)]
    sent = spark.createDataFrame(rows, "prediction_id string, up_probability double, confidence double")
    for _ in range(2):
        tb.keep_rejects(rg.refused(sent), root, "predictions", "prediction_id")
    got = {r.reason: r.rejected for r in tb.reject_counts(spark, root).collect()}
    assert got == {"probability out of range": 2, "probability missing": 1, "confidence missing": 1, "confidence out of range": 1}
    assert sorted(r.prediction_id for r in rg.checked(sent).collect()) == ["a", "g"]


def test_a_run_goes_on_after_its_finished_steps(spark, tmp_path):
    calls = []

    def step(name, fail=False):
        def run():
            calls.append(name)
            if fail:
                raise RuntimeError("no feed")
            return len(calls)
        return run

    ledger = lambda run_id: dl.Ledger(spark, str(tmp_path), run_id)
    dl.run_steps({"a": step("a"), "b": step("b", True), "c": step("c")}, ledger=ledger("r1"))
    again = dl.run_steps({"a": step("a"), "b": step("b"), "c": step("c")}, ledger=ledger("r1"))
    assert calls == ["a", "b", "b", "c"] and [(s, n) for _, s, n, _ in again] == [("REUSED", 1), ("SUCCESS", 3), ("SUCCESS", 4)]
    assert ledger("r2").finished() == {} and ledger("r1").finished() == {"a": 1, "b": 3, "c": 4}


def test_steps_stop_after_failure():
    def broken():
        raise RuntimeError("no feed")

    steps = {"a": lambda: 1, "b": broken, "c": lambda: 2}
    assert [s for _, s, _, _ in dl.run_steps(steps)] == ["SUCCESS", "FAILED", "SKIPPED"]
    assert [s for _, s, _, _ in dl.run_steps(steps, keep_going=True)] == ["SUCCESS", "FAILED", "SUCCESS"]


def test_daily_run_end_to_end(spark, tmp_path):
    layout = tb.Layout(str(tmp_path / "lake"))
    feed = spark.createDataFrame(walk(140, ("AAA", "BBB")), BAR_DDL).withColumn("seq", F.lit(1))
    arts = spark.createDataFrame(
        [("a1", "S", "2024-03-01T10:00:00+05:00", "Net profit jumps", "strong"), ("a2", "S", "2024-03-04 08:00:00", "Loss", ""),
         ("a3", "S", "soon", "Dividend", "")],
        "article_id string, source string, published_at string, headline string, summary string",
    )
    macro = spark.createDataFrame(
        [("CPI_YOY", day(0), day(1), 20.0)], "indicator string, observation_date date, public_release_date date, value double"
    )
    cols = ["return_1d", "dist_sma_20", "rsi_14"]

    def steps():
        return dl.daily_steps(spark, layout, feed, ["seq"], arts, None, macro, cols, "logistic", md.Params(logit_iterations=20))

    first = dl.run_daily(spark, layout, steps())
    assert [s for _, s, _, _ in first] == ["SUCCESS"] * 6, first
    counts = {n: k for n, _, k, _ in first}
    assert counts["bars"] == 280 and counts["news"] == 3 and counts["features"] == 280 and counts["predictions"] == 2
    second = {n: k for n, _, k, _ in dl.run_daily(spark, layout, steps())}
    assert second["bars"] == 0 and second["news"] == 0
    assert [(r.reason, r.rejected) for r in tb.reject_counts(spark, layout.rejects).collect()] == [("publication time unreadable", 1)]
    runs = tb.recent_runs(spark.read.schema(tb.RUNS).json(layout.runs)).collect()
    assert len(runs) == 2 and all(r.succeeded == 6 for r in runs)


def test_model_save_and_load(spark, tmp_path):
    rows = [("AAA", day(i), float(i % 5), float(i % 3), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, trade_date date, a double, b double, target_next_day_dir double")
    model = md.fit("logistic", df, ["a", "b"])
    path = str(tmp_path / "m")
    md.save(model, path)
    left, right = (sorted(r.p for r in md.score(m, df).collect()) for m in (model, md.load(path)))
    assert left == pytest.approx(right)
    top = md.importances(model, ["a", "b"], spark, 1).collect()
    assert len(top) == 1 and md.usable_columns(df, ["a", "b"], 61) == []


def test_scaling_uses_training_rows_only(spark):
    from marketloom.plans.evaluate import standardise
    rows = [("AAA", "train", 1.0), ("AAA", "train", 3.0), ("AAA", "test", 100.0)]
    df = spark.createDataFrame(rows, "symbol string, role string, f double")
    got = {r.role: r.f for r in standardise(df, ["f"]).orderBy("f").collect()}
    assert got["test"] == 98.0


def test_stream_upsert_is_idempotent_and_restarts(spark, tmp_path):
    inbox, table, ckpt = (str(tmp_path / n) for n in ("in", "table", "ckpt"))
    df = spark.createDataFrame(walk(20, ("AAA",)), BAR_DDL).withColumn("seq", F.lit(1))
    df.filter(F.col("trade_date") < day(10)).coalesce(1).write.mode("append").parquet(inbox)

    def run():
        st.run_batches(st.read_files(spark, inbox, df.schema), ckpt, st.upsert_bars(table, ["seq"]))
        return spark.read.parquet(table).count()

    assert run() == 10
    df.coalesce(1).write.mode("append").parquet(inbox)
    assert run() == 20
    assert run() == 20


def test_late_release_is_visible_from_its_date(spark, tmp_path):
    from marketloom.functions import calendar as cal
    schema = "indicator string, observation_date date, public_release_date date, value double"
    inbox = str(tmp_path / "in")
    sessions = lambda: cal.trading_days(cal.Calendar().between(spark, "2024-01-01", "2024-01-31"))
    handle = st.late_releases(str(tmp_path / "raw"), str(tmp_path / "daily"), sessions)
    for k, (release, value) in enumerate([(day(9), 20.0), (day(2), 18.0)]):
        spark.createDataFrame([("CPI_YOY", day(0), release, value)], schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = st.read_files(spark, inbox, spark.createDataFrame([], schema).schema)
        st.run_batches(stream, str(tmp_path / "ckpt"), handle)
        assert k in (0, 1)
    got = {r.session_date: r.cpi_yoy for r in tb.read_version(spark, str(tmp_path / "daily")).collect()}
    assert got[day(1)] is None and got[day(3)] == 18.0 and got[day(9)] == 20.0
    assert dt.date(2024, 1, 1) in got
