import datetime as dt
import random

import pytest

from marketloom.plans import evaluate as ev
from marketloom.plans import monitor as mn
from marketloom.plans import registry as rg
from marketloom.plans import views as vw
from marketloom.schemas import PREDICTIONS

from helpers import BAR_DDL, closes, day


def _scored(spark, pairs):
    return spark.createDataFrame([("AAA", day(0), float(p), float(y)) for p, y in pairs], "symbol string, target_date date, p double, y double")


@pytest.mark.parametrize("p,y,want", [([1, 0, 1, 0], [1, 0, 1, 0], 0.0), ([0, 1, 0], [1, 0, 1], 1.0), ([0.5] * 4, [1, 0, 1, 0], 0.25), ([], [], 0.0)])
def test_brier(spark, p, y, want):
    assert mn.brier(_scored(spark, zip(p, y, strict=True))).first().brier_score == want


def test_bins_and_ece(spark):
    rng = random.Random(42)
    pairs = [(p, float(rng.random() < p)) for p in (rng.uniform(0.05, 0.95) for _ in range(2000))]
    bins = mn.reliability_bins(_scored(spark, pairs))
    rows = bins.collect()
    assert len(rows) == 10 and sum(r["count"] for r in rows) == 2000
    assert mn.calibration_error(bins).first().ece < 0.06
    edge = {r.bin: r["count"] for r in mn.reliability_bins(_scored(spark, [(0.3, 1), (1.0, 1), (0.0, 0)])).collect()}
    assert edge[3] == 1 and edge[9] == 1 and edge[0] == 1


def test_calibration_status(spark):
    bad = mn.calibration_report(_scored(spark, [(0.95, 0)] * 30)).first()
    assert bad.status == "SEVERE_MISCALIBRATION" and bad.brier_score > 0.8
    none = mn.calibration_report(_scored(spark, [])).first()
    assert none.status == "HEALTHY" and none.samples == 0


def _values(spark, ref, cur):
    rows = [("AAA", "f", "ref", float(x)) for x in ref] + [("AAA", "f", "cur", float(x)) for x in cur]
    return spark.createDataFrame(rows, "symbol string, feature string, role string, x double")


def test_psi_levels(spark):
    rng = random.Random(1)
    base = [rng.gauss(0, 1) for _ in range(2000)]
    same, moved, far = ([rng.gauss(m, 1) for _ in range(2000)] for m in (0, 0.35, 2))
    got = [mn.psi(_values(spark, base, x)).first().psi for x in (same, moved, far)]
    assert got[0] < 0.05 and 0.08 <= got[1] < 0.30 and got[2] >= 0.25
    assert mn.psi(_values(spark, [1.0] * 50, [2.0] * 50)).first().psi == 0.0


def test_ks(spark):
    rng = random.Random(2)
    base = [rng.gauss(0, 1) for _ in range(500)]
    same = mn.ks(_values(spark, base, [rng.gauss(0, 1) for _ in range(500)])).first()
    far = mn.ks(_values(spark, base, [rng.gauss(1.5, 1) for _ in range(500)])).first()
    assert same.ks_p_value > 0.05 and far.ks_stat > 0.3 and far.ks_p_value < 1e-5


def _auc(pairs):
    pos, neg = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_auc_matches_pair_count(spark):
    rng = random.Random(3)
    pairs = [(round(rng.random(), 2), int(rng.random() < 0.4)) for _ in range(300)]
    df = spark.createDataFrame([("m", p, float(y)) for p, y in pairs], "model string, p double, y double")
    for fanout in (1, 7, 4096):
        assert ev.auc(df, "model", fanout=fanout).first().roc_auc == pytest.approx(_auc(pairs), rel=1e-12)


def test_macro_metrics_with_empty_class(spark):
    df = spark.createDataFrame([("m", 1.0, 1.0), ("m", 0.0, 1.0), ("m", 1.0, 1.0)], "model string, y double, pred double")
    r = ev.class_metrics(df, "model").first()
    assert r.accuracy == pytest.approx(2 / 3) and r.precision_macro == pytest.approx(1 / 3) and r.recall_macro == 0.5


def test_weights_find_the_better_model(spark):
    rows = [(float(i % 2), 0.9 if i % 2 else 0.1, 0.5, 0.4) for i in range(40)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    w = ev.ensemble_weights(df, ["a", "b", "c"]).first()
    assert (w.weight_a, w.weight_b, w.weight_c) == (1.0, 0.0, 0.0)
    none = ev.ensemble_weights(df.filter("y > 9"), ["a", "b"]).first()
    assert (none.weight_a, none.weight_b) == (0.5, 0.5)


def _prediction(i, target, p, signal=None):
    return (f"p{i}", "AAA", dt.datetime(2024, 1, 1), target, "m", "1", p, None, signal, 0.5, "1", "{}", None, None)


def test_reconcile_and_audit(spark):
    bars = closes(spark, [100.0, 102.0, 99.0])
    reg = spark.createDataFrame([_prediction(1, day(1), 0.8, "BUY"), _prediction(2, day(2), 0.2, "SELL"), _prediction(3, day(9), 0.5, "HOLD")], PREDICTIONS)
    done = rg.reconcile(reg, bars)
    got = {r.prediction_id: (r.realized_outcome, r.is_correct) for r in done.collect()}
    assert got["p1"] == (0.02, True) and got["p2"] == (-0.029412, True) and got["p3"] == (None, None)
    total = rg.audit(done).filter("symbol = 'ALL'").first()
    assert (total.resolved_records, total.pending_records, total.hit_rate) == (2, 1, 1.0)
    assert total.brier_score == pytest.approx(0.04)
    again = rg.reconcile(done, bars)
    assert {r.prediction_id: r.realized_outcome for r in again.collect()} == {k: v[0] for k, v in got.items()}


def test_registry_dedupe_and_checks(spark):
    a = spark.createDataFrame([_prediction(1, day(1), 0.8, "BUY")], PREDICTIONS)
    b = spark.createDataFrame([_prediction(1, day(1), 0.3, "SELL"), _prediction(2, day(1), 1.5, "BUY")], PREDICTIONS)
    got = rg.append_predictions(a, b).collect()
    assert [(r.prediction_id, r.up_probability) for r in got] == [("p1", 0.3)]
    assert rg.find_predictions(a, "aaa", unresolved=True).count() == 1


def test_overview_and_search(spark):
    bars = closes(spark, [100.0, 110.0])
    uni = spark.createDataFrame([("AAA", "Alpha Co", "Tech", True), ("BBB", "Beta", "Oil", True)], "symbol string, name string, sector string, enabled boolean")
    reg = spark.createDataFrame([_prediction(1, day(1), 0.8, "BUY")], PREDICTIONS)
    got = {r.symbol: r for r in vw.market_overview(uni, bars, reg).collect()}
    assert got["AAA"].change_1d == pytest.approx(10.0) and got["AAA"].signal == "BUY"
    assert got["BBB"].signal == "N/A" and got["BBB"].data_status == "Missing"
    assert vw.search(vw.market_overview(uni, bars, reg), "alph").count() == 1


def test_feed_freshness(spark):
    bars = spark.createDataFrame([("AAA", day(0), 1.0, 1.0, 1.0, 1.0, 1), ("AAA", day(9), 1.0, 1.0, 1.0, 1.0, 1)], BAR_DDL)
    uni = spark.createDataFrame([("AAA", True), ("BBB", True), ("CCC", False)], "symbol string, enabled boolean")
    from pyspark.sql import functions as F
    f = mn.feed_freshness(uni, bars, F.lit(day(12)))
    assert {(r.symbol, r.is_stale, r.gaps) for r in f.collect()} == {("AAA", False, 1), ("BBB", True, 0)}
    assert mn.feed_summary(f).first().status == "DEGRADED"
