"""Derivatives, splits, whole fits, early stop and probabilities of the boosted family."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.plans import boosting as bo
from marketloom.plans import evaluate as ev
from marketloom.plans import models as md


def rows(spark, classes):
    rng = random.Random(4)
    out = []
    for d in range(60):
        for s in "AB":
            a, b = rng.random(), rng.random()
            y = float(a > 0.5) if classes == 2 else float((a > 0.33) + (a > 0.66)) - 1.0
            out.append((s, dt.date(2024, 1, 1) + dt.timedelta(days=d), a, b, y if rng.random() < 0.9 else 0.0))
    return spark.createDataFrame(out, "symbol string, trade_date date, a double, b double, y double").coalesce(1)


def test_derivatives_match_the_loss():
    rng = np.random.default_rng(0)
    for outputs in (1, 3):
        margins, codes = rng.normal(size=(40, outputs)), rng.integers(0, max(2, outputs), 40)
        first, second = bo.derivatives(margins, codes)
        for i in range(40):
            for k in range(outputs):
                def loss(x, i=i, k=k):
                    moved = margins[i : i + 1].copy()
                    moved[0, k] += x
                    return bo.log_loss(moved, codes[i : i + 1])

                e = 1e-4
                assert abs((loss(e) - loss(-e)) / (2 * e) - first[i, k]) < 1e-6
                slope = (loss(e) - 2 * loss(0.0) + loss(-e)) / e**2
                # of more than two classes the bound used is twice the diagonal
                assert abs(slope * (1 if outputs == 1 else 2) - second[i, k]) < 1e-4


def test_best_split_against_all_cuts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        g, h = rng.normal(size=(3, 6)), rng.uniform(0.2, 2, size=(3, 6))
        g, h = g * (g[0].sum() / g.sum(axis=1))[:, None], h * (h[0].sum() / h.sum(axis=1))[:, None]
        options = []
        for f in range(3):
            for b in range(5):
                (a, x), (c, y) = (g[f, : b + 1].sum(), h[f, : b + 1].sum()), (g[f, b + 1 :].sum(), h[f, b + 1 :].sum())
                if min(x, y) >= bo.LEAST_HESSIAN and f != 1:
                    options.append(a * a / (x + 1) + c * c / (y + 1) - g[0].sum() ** 2 / (h[0].sum() + 1))
        gain, f, _ = bo.best_split(g, h, np.array([True, False, True]))
        assert f != 1 and abs(gain - max(options)) < 1e-9


def grown_plainly(x, y, cuts, rounds, rate, depth, classes):
    """The same trees without Spark: every node looks at all its rows."""
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    margins = np.zeros((len(y), 1 if classes == 2 else classes))
    for _ in range(rounds):
        g, h = bo.derivatives(margins, y)
        step = np.zeros_like(margins)
        for k in range(margins.shape[1]):
            def split(rows, level, k=k):
                a, b = g[rows, k].sum(), h[rows, k].sum()
                best = (1e-12, None)
                if level < depth:
                    for f in range(bins.shape[1]):
                        for cut in range(bo.BINS - 1):
                            left = bins[rows, f] <= cut
                            la, lb = g[rows[left], k].sum(), h[rows[left], k].sum()
                            if lb >= 1 and b - lb >= 1:
                                gain = la**2 / (lb + 1) + (a - la) ** 2 / (b - lb + 1) - a * a / (b + 1)
                                if gain > best[0] + 1e-9:
                                    best = (gain, left)
                if best[1] is None:
                    step[rows, k] = -a / (b + 1)
                else:
                    split(rows[best[1]], level + 1)
                    split(rows[~best[1]], level + 1)

            split(np.arange(len(y)), 0)
        margins += rate * step
    return bo.probabilities(margins)


def test_trees_match_a_plain_fit(spark):
    for classes in (2, 3):
        data = rows(spark, classes).withColumn("code", F.col("y") + (classes - 2))
        model = bo.fit_boosted(data, ["a", "b"], F.col("code"), F.lit(False), classes, 3, 0.5, 2)
        got = model.transform(data).orderBy("trade_date", "symbol").collect()
        x = np.array([(r.a, r.b) for r in got])
        want = grown_plainly(x, np.array([int(r.code) for r in got]), model.cuts, 3, 0.5, 2, classes)
        assert len(model.rounds) == 3 and np.abs(np.array([r.probs for r in got]) - want).max() < 1e-9


def test_boosting_is_cut_at_the_best_round(spark, tmp_path):
    data = rows(spark, 2)
    params = md.Params(rounds=12, patience=2, rate=0.9, boost_depth=2, subsample=1.0, columns=1.0)
    model = md.fit("boosted", data, ["a", "b"], "y", params)
    least = int(np.argmin(model.losses))
    assert len(model.rounds) == max(1, least) and (len(model.losses) == 13 or len(model.losses) - 1 - least == 2)
    marked = md._mark_validation(data, params.validation)
    held = model.transform(marked.filter("_valid")).select("y", "probs").collect()
    assert abs(-sum(math.log(r.probs[int(r.y)]) for r in held) / len(held) - model.losses[len(model.rounds)]) < 1e-9
    md.save(model, str(tmp_path / "m"))
    left, right = (sorted(r.p for r in md.score(m, data).collect()) for m in (model, md.load(str(tmp_path / "m"))))
    assert left == right and abs(sum(model.importances()) - 1) < 1e-9


def test_three_classes_have_probabilities_and_an_auc(spark):
    data = rows(spark, 3)
    params = md.Params(rounds=3, patience=2, rate=0.5, boost_depth=2)
    scored = md.score(md.fit("boosted", data, ["a", "b"], "y", params, classes=3), data, classes=3)
    got = scored.select("y", "pred", "p", "probs").collect()
    for r in got:
        assert abs(sum(r.probs) - 1) < 1e-9 and len(r.probs) == 3 and r.p == r.probs[2]
        assert r.pred == r.probs.index(max(r.probs)) - 1
    assert sum(r.y == r.pred for r in got) / len(got) > 0.7
    auc = ev.auc_ovr(scored.withColumn("all", F.lit(1)), [-1.0, 0.0, 1.0], "all").first()["roc_auc"]
    assert auc > 0.8


def test_ensemble_weights_reach_the_optimum_of_the_simplex(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        y = float(rng.random() < 0.5)
        rows.append((y, *(min(max(0.5 + (y - 0.5) * lean + rng.uniform(-wide, wide), 0.0), 1.0) for lean, wide in ((0.5, 0.4), (0.3, 0.2), (-0.4, 0.5)))))
    got = ev.ensemble_weights(spark.createDataFrame([*rows, (None, 0.1, 0.1, 0.1), (1.0, None, 0.2, 0.2)], "y double, a double, b double, c double"), ["a", "b", "c"]).first()

    def loss(w):
        clip = lambda p: min(max(p, 1e-6), 1 - 1e-6)
        return -sum(math.log(sum(k * (clip(p) if y == 1 else 1 - clip(p)) for k, p in zip(w, ps))) for y, *ps in rows) / len(rows)

    w = [got.weight_a, got.weight_b, got.weight_c]
    grid = min(loss((i / 100, j / 100, (100 - i - j) / 100)) for i in range(101) for j in range(101 - i))
    assert sum(w) == pytest.approx(1.0) and min(w) >= 0 and got.log_loss == pytest.approx(loss(w), abs=1e-12)
    assert got.log_loss <= grid + 1e-6 and got.weight_c < 0.01


def test_ensemble_weights_of_odd_tables(spark):
    empty = ev.ensemble_weights(spark.createDataFrame([], "y double, a double, b double"), ["a", "b"]).first()
    assert (empty.weight_a, empty.weight_b, empty.log_loss) == (0.5, 0.5, None)
    same = ev.ensemble_weights(spark.createDataFrame([(1.0, 0.7, 0.7), (0.0, 0.4, 0.4)], "y double, a double, b double"), ["a", "b"]).first()
    assert same.weight_a == pytest.approx(0.5)
    best = ev.ensemble_weights(spark.createDataFrame([(1.0, 1.0, 0.0), (0.0, 0.0, 1.0)], "y double, a double, b double"), ["a", "b"]).first()
    assert best.weight_a > 0.999 and best.log_loss < 1e-5


def test_a_pass_is_one_job(spark):
    data, sc = rows(spark, 3).withColumn("code", F.col("y") + 1), spark.sparkContext

    def jobs(rounds):
        group = f"boosted {rounds}"
        sc.setJobGroup(group, group)
        try:
            model = bo.fit_boosted(data, ["a", "b"], F.col("code"), F.lit(False), 3, rounds, 0.5, 2)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert len(model.rounds) == rounds
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs(6) - jobs(2) <= 4 * 2


def test_fits_beside_each_other_come_back_in_order(spark):
    data = rows(spark, 2)
    kinds = ["logistic", "boosted", "logistic", "boosted"]
    params = md.Params(rounds=2, boost_depth=2)
    got = md.fit_all([(kind, data, names, "y", params) for kind, names in zip(kinds, (["a"], ["a"], ["a", "b"], ["a", "b"]))])
    assert [isinstance(m, bo.Boosted) for m in got] == [k == "boosted" for k in kinds]
    assert got[1].features == ["a"] and got[3].features == ["a", "b"] and got[2].stages[-1].numFeatures == 2


def test_tasks_follow_the_rows(spark):
    # a pass over few blocks is all start-up: fits beside each other would take each other's cores
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for blocks, tasks in ((1, 1), (12, 1), (45, 4), (10_000, 834)):
        assert bo._tasks(spark.range(blocks)) == min(tasks, most)


def test_rounds_are_one_job(spark):
    data, sc = rows(spark, 3).withColumn("code", F.col("y") + 1), spark.sparkContext

    def jobs(rounds):
        group = f"one job {rounds}"
        sc.setJobGroup(group, group)
        try:
            bo.fit_boosted(data, ["a", "b"], F.col("code"), F.lit(False), 3, rounds, 0.5, 2)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        return len(sc.statusTracker().getJobIdsForGroup(group))

    assert jobs(6) == jobs(2)


@pytest.mark.parametrize("classes", [2, 3])
def test_both_ways_grow_the_same_trees(spark, monkeypatch, classes):
    data = rows(spark, classes).withColumn("code", F.col("y") + (classes - 2))
    monkeypatch.setattr(bo, "BLOCK_ROWS", 8)
    monkeypatch.setattr(bo, "_tasks", lambda table: 3)
    # small batches, so that there are blocks for several tasks
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        def fit():
            held = F.col("trade_date") >= dt.date(2024, 2, 20)
            return bo.fit_boosted(data, ["a", "b"], F.col("code"), held, classes, 30, 0.5, 3, 0.8, 0.6, 3)

        in_one_job = fit()
        monkeypatch.setattr(bo, "ALONE_ROWS", 0)
        by_passes = fit()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(in_one_job.rounds) == len(by_passes.rounds) > 2 and np.allclose(in_one_job.losses, by_passes.losses, rtol=0, atol=1e-12)
    for one, other in zip(in_one_job.rounds, by_passes.rounds):
        for x, y in zip(one, other):
            assert (x.feature == y.feature).all() and (x.bin == y.bin).all() and np.allclose(x.value, y.value, rtol=0, atol=1e-12)


def test_a_fit_without_rows_has_no_opinion(spark):
    data = rows(spark, 2).withColumn("code", F.col("y"))
    model = bo.fit_boosted(data.where("y > 5"), ["a", "b"], F.col("code"), F.lit(False), 2, 3, 0.5, 2)
    assert {tuple(r.probs) for r in model.transform(data).collect()} == {(0.5, 0.5)}
