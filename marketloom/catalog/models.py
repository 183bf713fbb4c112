"""I4-I20 (baselines, fits, evaluation, ensembles), J2 and K1."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.backtests import CLEAN, locked_bars
from marketloom.catalog.macro import dated_news, macro_table
from marketloom.catalog.registry import query, r, sr
from marketloom.functions.indicators import TECHNICAL
from marketloom.plans import evaluate as ev
from marketloom.plans import features as ft
from marketloom.plans import models as md
from marketloom.plans import split as sp
from marketloom.session import cut_lineage

COLUMNS = list(TECHNICAL)


def split_rows(spark, sf):
    """Two features, the label and the role of each clean row."""
    from marketloom.catalog.backtests import FEATURES, small_features
    return sp.chronological_split(small_features(spark, sf), FEATURES).withColumn("y", F.col("target_next_day_dir"))


SPLIT = CLEAN + """,
rows AS (SELECT c.*, ln(f.close / f.p) AS return_1d, f.sma_20, CASE WHEN row_no < floor(n_rows * 0.8e0) THEN 'train' ELSE 'test' END AS role
         FROM clean c JOIN feat f USING (symbol, trade_date) WHERE n_rows >= 20)"""


@query("i4_majority_baseline", fx.sql(SPLIT, f"""
SELECT symbol, CASE WHEN sum(y) > count(*) - sum(y) THEN 1e0 ELSE 0e0 END AS majority, count(*) AS n_train, {sr('avg(y)')} AS up_share FROM rows WHERE role = 'train' GROUP BY symbol"""))
def i4(spark, sf):
    return ev.majority_class(split_rows(spark, sf).filter("role = 'train'"), "symbol").select(
        "symbol", "majority", "n_train", r(F.element_at("priors", F.lit(1.0))).alias("up_share"))


@query("i5_naive_persistence", fx.sql(SPLIT, """
SELECT symbol, trade_date, CASE WHEN return_1d > 0 THEN 1e0 ELSE 0e0 END AS pred, CASE WHEN return_1d > 0.0075 THEN 1e0 WHEN return_1d < -0.0075 THEN -1e0 ELSE 0e0 END AS pred3,
       CASE WHEN return_1d > 0 THEN 0.9999e0 ELSE 0.0001e0 END AS p FROM rows WHERE role = 'test'"""))
def i5(spark, sf):
    ret = F.col("return_1d")
    pred = ev.persistence(ret)
    return split_rows(spark, sf).filter("role = 'test'").select(
        "symbol", "trade_date", pred.alias("pred"), ev.persistence(ret, three_class=True).alias("pred3"), r(ev.hard_probability(pred, 1.0)).alias("p"))


@query("i6_sma_crossover_baseline", fx.sql(SPLIT, "SELECT symbol, trade_date, CASE WHEN close > sma_20 THEN 1e0 ELSE 0e0 END AS pred FROM rows JOIN feat USING (symbol, trade_date, sma_20) WHERE role = 'test'"))
def i6(spark, sf):
    return split_rows(spark, sf).filter("role = 'test'").select("symbol", "trade_date", ev.crossover(F.col("close"), F.col("sma_20")).alias("pred"))


@query("i7_train_only_scaling", fx.sql(SPLIT + """,
st AS (SELECT symbol, avg(return_1d) AS m1, stddev_pop(return_1d) AS s1, avg(sma_20) AS m2, stddev_pop(sma_20) AS s2 FROM rows WHERE role = 'train' GROUP BY symbol)""", f"""
SELECT symbol, trade_date, role, {sr('(return_1d - m1) / s1')} AS return_1d, {sr('(sma_20 - m2) / s2')} AS sma_20 FROM rows JOIN st USING (symbol)"""))
def i7(spark, sf):
    return ev.standardise(split_rows(spark, sf), ["return_1d", "sma_20"]).select("symbol", "trade_date", "role", r("return_1d").alias("return_1d"), r("sma_20").alias("sma_20"))


def label_scores(spark, sf):
    """Labelled documents with a score from their size on a 1/64 grid: three groups, y = quality."""
    docs = fx.table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    p = F.pmod(F.col("n_chars") * 5 + F.col("doc_id"), F.lit(65)) / 64.0
    return fx.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.concat(F.lit("m"), F.col("doc_id") % 3).alias("model"), F.col("quality").cast("double").alias("y"), p.alias("p"),
        F.when(p >= 0.5, 1.0).otherwise(0.0).alias("pred"), "doc_id")


SCORED = """
scored AS (SELECT 'm' || (l.doc_id % 3) AS model, quality::DOUBLE AS y, ((n_chars * 5 + l.doc_id) % 65) / 64e0 AS p,
                  CASE WHEN ((n_chars * 5 + l.doc_id) % 65) / 64e0 >= 0.5 THEN 1e0 ELSE 0e0 END AS pred, l.doc_id FROM labels l JOIN documents USING (doc_id))"""
EVAL = SCORED + """,
cls AS (SELECT model, c, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (pred = c) AS said, count(*) FILTER (y = c) AS t, count(*) AS n
        FROM scored, (SELECT unnest([0e0, 1e0]) AS c) GROUP BY model, c),
ranks AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY p) + (count(*) OVER (PARTITION BY model, p) - 1) / 2e0 AS rk FROM scored),
au AS (SELECT model, (sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2e0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS roc_auc FROM ranks GROUP BY model)"""


@query("i11_classifier_evaluation", fx.sql(EVAL, f"""
SELECT model, sum(t)::BIGINT AS n_test, {sr('sum(tp) / sum(t)')} AS accuracy, {sr('avg(CASE WHEN said > 0 THEN tp / said ELSE 0 END)')} AS precision_macro,
       {sr('avg(CASE WHEN t > 0 THEN tp / t ELSE 0 END)')} AS recall_macro, {sr('avg(2e0 * tp / (said + t))')} AS f1_macro, {sr('any_value(roc_auc)')} AS roc_auc, {sr('any_value(b)')} AS brier_score
FROM cls JOIN au USING (model) JOIN (SELECT model, avg(pow(p - y, 2)) AS b FROM scored GROUP BY model) USING (model) WHERE said + t > 0 GROUP BY model"""))
def i11(spark, sf):
    out = ev.evaluate(label_scores(spark, sf), "model")
    return out.withColumns({c: r(c) for c in out.columns if c not in ("model", "n_test")})


@query("i11_confusion_matrix", fx.sql(SCORED, "SELECT model, y, pred, count(*) AS n FROM scored GROUP BY ALL"))
def i11c(spark, sf):
    return ev.confusion(label_scores(spark, sf), "model")


@query("i11_multiclass_auc", fx.sql(SCORED + """,
o AS (SELECT model, c, CASE c WHEN 0 THEN p WHEN 1 THEN 1 - p ELSE p * p END AS pc, (doc_id % 3 = c)::INT AS yc FROM (SELECT 'all' AS model, p, doc_id FROM scored), (SELECT unnest([0, 1, 2]) AS c)),
rk AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY pc) + (count(*) OVER (PARTITION BY c, pc) - 1) / 2e0 AS rk FROM o),
au AS (SELECT model, c, (sum(rk) FILTER (yc = 1) - count(*) FILTER (yc = 1) * (count(*) FILTER (yc = 1) + 1) / 2e0) / (count(*) FILTER (yc = 1) * count(*) FILTER (yc = 0)) AS a FROM rk GROUP BY ALL)""",
    f"SELECT model, {sr('avg(a)')} AS roc_auc FROM au GROUP BY model"))
def i11m(spark, sf):
    df = label_scores(spark, sf).select(
        F.lit("all").alias("model"), (F.col("doc_id") % 3).cast("double").alias("y"), F.array(F.col("p"), 1.0 - F.col("p"), F.col("p") * F.col("p")).alias("probs"))
    return ev.auc_ovr(df, [0.0, 1.0, 2.0], "model").withColumn("roc_auc", r("roc_auc"))


@query("i13_ensemble_weights", fx.sql(SCORED + """,
oof AS (SELECT y, p AS a, CASE WHEN doc_id % 4 = 0 THEN 1 - y * 0.75 ELSE 0.25 + y * 0.5 END AS b, 0.5e0 AS c FROM scored),
lik AS (SELECT CASE WHEN y = 1 THEN a ELSE 1 - a END AS a, CASE WHEN y = 1 THEN b ELSE 1 - b END AS b, CASE WHEN y = 1 THEN c ELSE 1 - c END AS c, count(*) AS n
        FROM (SELECT y, greatest(least(a, 1 - 1e-6), 1e-6) AS a, greatest(least(b, 1 - 1e-6), 1e-6) AS b, c FROM oof) GROUP BY ALL),
em AS (SELECT 0 AS i, 1 / 3e0 AS wa, 1 / 3e0 AS wb, 1 / 3e0 AS wc
       UNION ALL
       SELECT any_value(i) + 1, sum(n * wa * a / (wa * a + wb * b + wc * c)) / sum(n), sum(n * wb * b / (wa * a + wb * b + wc * c)) / sum(n),
              sum(n * wc * c / (wa * a + wb * b + wc * c)) / sum(n)
       FROM em, lik WHERE i < 3000 HAVING count(*) > 0)""", f"""
SELECT {sr('any_value(wa)', 3)} AS weight_a, {sr('any_value(wb)', 3)} AS weight_b, {sr('any_value(wc)', 3)} AS weight_c,
       {sr('sum(-n * ln(wa * a + wb * b + wc * c)) / sum(n)')} AS log_loss
FROM em, lik WHERE i = 3000""", recursive=True))
def i13(spark, sf):
    oof = label_scores(spark, sf).select(
        "y", F.col("p").alias("a"), F.when(F.col("doc_id") % 4 == 0, 1 - F.col("y") * 0.75).otherwise(F.col("y") * 0.5 + 0.25).alias("b"), F.lit(0.5).alias("c"))
    out = ev.ensemble_weights(oof, ["a", "b", "c"])
    return out.select(*[r(f"weight_{m}", 3).alias(f"weight_{m}") for m in "abc"], r("log_loss").alias("log_loss"))


def panel(spark, sf):
    """All bars with indicators and targets, split on one date."""
    feats = ft.build_features(locked_bars(spark, sf))
    return sp.split_by_date(feats, COLUMNS, md.TARGET)


def merged_panel(spark, sf):
    return ft.merge_all(ft.build_features(locked_bars(spark, sf)), dated_news(spark, sf), macro_table(spark, sf))


@query("i8_logistic_regression")
def i8(spark, sf):
    return md.train_and_evaluate(panel(spark, sf), COLUMNS, ["logistic"])


@query("i9_random_forest")
def i9(spark, sf):
    return md.train_and_evaluate(panel(spark, sf), COLUMNS, ["random_forest"])


@query("i10_boosted_trees")
def i10(spark, sf):
    return md.train_and_evaluate(panel(spark, sf), COLUMNS, ["boosted"])


@query("i10_boosted_three_class")
def i10m(spark, sf):
    rows = panel(spark, sf)
    model = md.fit("boosted", rows.filter("role = 'train'"), COLUMNS, "target_next_day_3class", classes=3)
    scored = md.score(model, rows.filter("role = 'test'"), classes=3).withColumn("y", F.col("target_next_day_3class"))
    scored = cut_lineage(scored.select("symbol", "y", "pred", "probs"))
    return ev.class_metrics(scored, "symbol").join(ev.auc_ovr(scored, [-1.0, 0.0, 1.0], "symbol"), "symbol", "left")


@query("i12_out_of_fold_matrix")
def i12(spark, sf):
    train = panel(spark, sf).filter("role = 'train'")
    folds = sp.expanding_oof_folds(sp.row_counts(md.date_folds(train)), 4)
    return md.out_of_fold(train, {"price": ("random_forest", COLUMNS[:5]), "other": ("logistic", COLUMNS[5:])}, folds)


@query("i14_stacking_ensemble")
def i14(spark, sf):
    merged = merged_panel(spark, sf)
    specs = md.stack_specs(merged.columns, COLUMNS)
    rows = sp.split_by_date(merged, sorted({c for _, cols in specs.values() for c in cols}), md.TARGET)
    stack = md.fit_stack(rows.filter("role = 'train'"), specs)
    scored = stack.score(rows.filter("role = 'test'")).withColumn("y", F.col(md.TARGET))
    scored = cut_lineage(scored.select("symbol", "y", "pred", "p"))
    return ev.evaluate(scored, "symbol").withColumns({f"weight_{n}": F.lit(w) for n, w in stack.weights.items()})


@query("i15_train_and_evaluate")
def i15(spark, sf):
    return md.train_and_evaluate(panel(spark, sf), COLUMNS, ["logistic", "random_forest", "boosted"])


@query("i16_model_comparison")
def i16(spark, sf):
    return md.compare_models(panel(spark, sf), COLUMNS)


@query("i17_feature_ablation")
def i17(spark, sf):
    return md.ablation(merged_panel(spark, sf), COLUMNS)


@query("i18_usable_columns", fx.sql(CLEAN, "SELECT count(p) AS prev_close, count(sma_20) AS sma_20, count(nx) AS next_close FROM feat"))
def i18(spark, sf):
    from marketloom.catalog.backtests import small_features
    df = small_features(spark, sf)
    return md.column_counts(df.select(F.col("return_1d").alias("prev_close"), "sma_20", F.col("target_next_day_dir").alias("next_close")), ["prev_close", "sma_20", "next_close"])


@query("i19_feature_importances")
def i19(spark, sf):
    train = panel(spark, sf).filter("role = 'train'")
    return md.importances(md.fit("random_forest", train, COLUMNS), COLUMNS, spark, 5)


@query("j2_walk_forward_model_signals")
def j2(spark, sf):
    rows = panel(spark, sf)
    folds = sp.walk_forward_folds(sp.row_counts(md.date_folds(rows)), 400, 60, 60, 5)
    return md.walk_forward_signals(rows, COLUMNS, folds)


@query("k1_forward_scoring")
def k1(spark, sf):
    feats = ft.build_features(locked_bars(spark, sf))
    return md.forward_predictions(feats, COLUMNS).drop("prediction_id", "generated_at")
