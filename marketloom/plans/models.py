"""Model fits on pyspark.ml: one panel model over all symbols, split by date.

Driver loops run over folds, feature sets and model families only, never over symbols.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.calendar import Calendar
from marketloom.plans import backtest as bt
from marketloom.plans import evaluate as ev
from marketloom.plans import registry as rg
from marketloom.plans.boosting import Boosted, fit_boosted
from marketloom.plans.features import INTERACTIONS
from marketloom.plans.macro import MACRO_FEATURES
from marketloom.plans.news import NEWS_FEATURES
from marketloom.session import cut_lineage

TARGET = "target_next_day_dir"


@dataclass(frozen=True)
class Params:
    """Hyper-parameters of the three families."""

    c: float = 1.0
    logit_iterations: int = 1000
    trees: int = 100
    depth: int = 5
    min_leaf: int = 20
    rounds: int = 200
    rate: float = 0.03
    boost_depth: int = 4
    subsample: float = 0.8
    columns: float = 0.8
    validation: float = 0.10
    patience: int = 20
    seed: int = 42


def usable_columns(df: DataFrame, columns: list[str], minimum: int = 20) -> list[str]:
    """Columns with at least ``minimum`` values, found by one aggregate over all of them."""
    row = column_counts(df, columns).first()
    return [c for c in columns if row[c] >= minimum]


def column_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count(c).alias(c) for c in columns])


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="_raw")


def _mark_validation(train: DataFrame, share: float) -> DataFrame:
    """Flags the newest share of training days for early stopping."""
    days = train.select("trade_date").distinct()
    rank = days.withColumn("_r", F.row_number().over(Window.orderBy(F.desc("trade_date"))))  # one row per day
    limit = F.floor(days.agg(F.count(F.lit(1))).scalar() * share)
    first = rank.filter(F.col("_r") <= limit).agg(F.min("trade_date")).scalar()
    return train.withColumn("_valid", F.coalesce(F.col("trade_date") >= first, F.lit(False)))


def fit(kind: str, train: DataFrame, features: list[str], target: str = TARGET, params: Params = Params(), classes: int = 2) -> PipelineModel | Boosted:
    """Fit one family on clean training rows; labels are class codes from 0."""
    data = train.withColumn("_label", F.col(target) if classes == 2 else F.col(target) + 1.0)
    if kind == "logistic":
        n = data.count()
        stages = [
            _assembler(features),
            StandardScaler(inputCol="_raw", outputCol="_features", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="_features", labelCol="_label", predictionCol="_code", probabilityCol="_prob",
                rawPredictionCol="_margin", regParam=1.0 / (params.c * n), elasticNetParam=0.0,
                standardization=False, maxIter=params.logit_iterations,
            ),
        ]
    elif kind == "random_forest":
        stages = [
            _assembler(features),
            RandomForestClassifier(
                featuresCol="_raw", labelCol="_label", predictionCol="_code", probabilityCol="_prob",
                rawPredictionCol="_margin", numTrees=params.trees, maxDepth=params.depth,
                minInstancesPerNode=params.min_leaf, seed=params.seed,
            ),
        ]
    elif kind == "boosted":
        return _boost(data, features, params, classes)
    else:
        raise ValueError(f"unknown model family {kind}")
    data = _for_iterations(data.select(*features, "_label"))
    try:
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def _for_iterations(rows: DataFrame, rows_per_task: int = 50_000) -> DataFrame:
    """Cached rows in few enough tasks that a pass over them is not all start-up.

    A fit makes hundreds of passes; the caller unpersists.
    """
    return rows.coalesce(max(1, -(-rows.count() // rows_per_task))).persist(StorageLevel.MEMORY_AND_DISK)


def _boost(data: DataFrame, features: list[str], params: Params, classes: int) -> Boosted:
    """Boosted trees on the older days, cut at the round that the newest days find best."""
    return fit_boosted(
        cut_lineage(_mark_validation(data, params.validation).select(*features, "_label", "_valid")), features, F.col("_label"), F.col("_valid"),
        classes, params.rounds, params.rate, params.boost_depth, params.subsample, params.columns, params.patience, params.seed,
    )


#: Fits that run beside each other; each is a chain of short jobs that leaves cores idle.
PARALLEL_FITS = 6


def fit_all(wanted: list[tuple]) -> list:
    """``fit`` for each tuple of its arguments, several at a time, boosted ones first, as they last longest."""
    if not wanted:
        return []
    order = sorted(range(len(wanted)), key=lambda k: wanted[k][0] != "boosted")
    with ThreadPool(min(PARALLEL_FITS, len(wanted))) as pool:
        spark = wanted[0][1].sparkSession
        found = pool.map(inheritable_thread_target(spark)(lambda args: fit(*args)), [wanted[k] for k in order], 1)
    return [model for _, model in sorted(zip(order, found), key=lambda pair: pair[0])]


def score(model: PipelineModel | Boosted, rows: DataFrame, classes: int = 2) -> DataFrame:
    """Adds pred (original class) and p = probability of the highest class; of more than two classes, probs."""
    out = model.transform(rows)
    if "_prob" in out.columns:
        out = out.withColumn("probs", vector_to_array("_prob"))
    pred = F.col("_code") if classes == 2 else F.col("_code") - 1.0
    out = out.withColumn("pred", pred).withColumn("p", F.get("probs", F.lit(classes - 1)))
    return out.drop(*[c for c in out.columns if c.startswith("_")], *(["probs"] if classes == 2 else []))


def importances(model: PipelineModel | Boosted, features: list[str], spark, k: int | None = None) -> DataFrame:
    """(rank, feature, weight): coefficients by magnitude, or tree importances."""
    if isinstance(model, Boosted):
        found = model.importances()
    else:
        last = model.stages[-1]
        found = (last.coefficients if hasattr(last, "coefficients") else last.featureImportances).toArray()
    weights = [(f, float(w)) for f, w in zip(features, found, strict=True)]
    table = spark.createDataFrame(weights, "feature string, weight double")
    w = Window.orderBy(F.desc(F.abs(F.col("weight"))), "feature")  # one row per feature
    ranked = table.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def drivers_json(top: DataFrame) -> str:
    packed = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "weight"))),
                                            lambda s: F.struct(s["feature"], F.round(s["weight"], 4))))
    return top.agg(F.to_json(packed).alias("j")).first()["j"]


def save(model: PipelineModel | Boosted, path: str) -> None:
    if isinstance(model, Boosted):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> PipelineModel | Boosted:
    return Boosted.load(path) if Boosted.saved_at(path) else PipelineModel.load(path)


# -- evaluation runs --------------------------------------------------------------


def _xy(rows: DataFrame, target: str) -> DataFrame:
    return rows.withColumn("y", F.col(target))


def train_and_evaluate(rows: DataFrame, features: list[str], kinds: list[str], target: str = TARGET, params: Params = Params()) -> DataFrame:
    """Metric rows keyed by (symbol, model); ``rows`` carry role train/test."""
    train, test = rows.filter("role = 'train'"), rows.filter("role = 'test'")
    scored = None
    for kind, model in zip(kinds, fit_all([(kind, train, features, target, params) for kind in kinds])):
        part = score(model, test).withColumn("model", F.lit(kind))
        part = _xy(part, target).select("symbol", "model", "trade_date", "y", "pred", "p")
        scored = part if scored is None else scored.unionByName(part)
    return ev.evaluate(cut_lineage(scored), "symbol", "model").withColumn("target", F.lit(target))


def baseline_scores(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Test rows under the three rule baselines."""
    train, test = _xy(rows.filter("role = 'train'"), target), _xy(rows.filter("role = 'test'"), target)
    major = ev.majority_class(train, "symbol")
    joined = test.join(major, "symbol")
    share = F.coalesce(F.element_at("priors", F.lit(1.0)), F.lit(0.0))

    def rule(name: str, pred, p):
        return F.struct(F.lit(name).alias("model"), pred.cast("double").alias("pred"), p.cast("double").alias("p"))

    naive, cross = ev.persistence(F.col("return_1d")), ev.crossover(F.col("sma_20"), F.col("sma_50"))
    options = F.array(
        rule("majority", F.col("majority"), share),
        rule("naive_persistence", naive, ev.hard_probability(naive, 1.0)),
        rule("sma_crossover", cross, ev.hard_probability(cross, 1.0)),
    )
    locks = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in joined.columns else F.lit(False).alias(c) for c in ("is_upper_lock", "is_lower_lock")]
    return joined.select("symbol", "trade_date", "close", *locks, "y", F.explode(options).alias("_o")).select(
        "symbol", "trade_date", "close", "is_upper_lock", "is_lower_lock", "y", "_o.*"
    )


def trading_view(scored: DataFrame) -> DataFrame:
    """Predictions as 0/1 signals for the backtest, the model name being the strategy."""
    return scored.select(
        "symbol", F.col("model").alias("strategy"), "trade_date", "close", "is_upper_lock", "is_lower_lock",
        F.when(F.col("pred") > 0, 1.0).otherwise(0.0).alias("signal"),
    )


def _model_scores(rows: DataFrame, model: PipelineModel | Boosted, name: str, target: str) -> DataFrame:
    part = _xy(score(model, rows.filter("role = 'test'")), target)
    locks = [F.col(c) if c in part.columns else F.lit(False).alias(c) for c in ("is_upper_lock", "is_lower_lock")]
    return part.select("symbol", "trade_date", "close", *locks, "y", F.lit(name).alias("model"), "pred", "p")


def compare_models(rows: DataFrame, features: list[str], target: str = TARGET, params: Params = Params(),
                   kinds: tuple[str, ...] = ("logistic", "random_forest", "boosted")) -> DataFrame:
    """Baselines and fitted families on the same test rows: classification and trading figures."""
    scored, train = baseline_scores(rows, target), rows.filter("role = 'train'")
    for kind, model in zip(kinds, fit_all([(kind, train, features, target, params) for kind in kinds])):
        scored = scored.unionByName(_model_scores(rows, model, kind, target))
    scored = cut_lineage(scored)
    money = bt.metrics(trading_view(scored)).withColumnRenamed("strategy", "model").drop("sessions")
    return ev.evaluate(scored, "symbol", "model").join(money, ["symbol", "model"], "left")


def ablation_sets(available: list[str], technical: list[str]) -> dict[str, list[str]]:
    """The five feature sets, each limited to available columns."""
    have = set(available)
    tech = [c for c in technical if c in have]
    market = [c for c in ("kse100_index", "kse100_return_1d", "rel_kse100_ret_1d") if c in have]
    news = [c for c in NEWS_FEATURES if c in have]
    macro = [c for c in [*MACRO_FEATURES, *INTERACTIONS] if c in have]
    union = lambda *parts: sorted({c for p in parts for c in p})
    return {
        "EXP_1": tech,
        "EXP_2": union(tech, market),
        "EXP_3": union(tech, news),
        "EXP_4": union(tech, macro),
        "EXP_5": union(tech, market, news, macro),
    }


def ablation(merged: DataFrame, technical: list[str], kind: str = "logistic", target: str = TARGET,
             ratio: float = 0.8, params: Params = Params()) -> DataFrame:
    """Every feature set on identical clean rows, with differences from the first set."""
    from marketloom.plans.split import split_by_date

    every = [*technical, *NEWS_FEATURES, *MACRO_FEATURES, *INTERACTIONS]
    merged = cut_lineage(merged)
    usable = usable_columns(merged, [c for c in every if c in merged.columns])
    sets = ablation_sets(usable, technical)
    rows = split_by_date(merged, sorted({c for s in sets.values() for c in s}), target, ratio)
    scored, train = None, rows.filter("role = 'train'")
    for name, model in zip(sets, fit_all([(kind, train, features, target, params) for features in sets.values()])):
        part = _model_scores(rows, model, name, target)
        scored = part if scored is None else scored.unionByName(part)
    scored = cut_lineage(scored)
    money = bt.metrics(trading_view(scored)).withColumnRenamed("strategy", "model").groupBy("model").agg(
        F.avg("total_return").alias("total_return"), F.avg("sharpe_ratio").alias("sharpe_ratio"),
        F.avg("max_drawdown").alias("max_drawdown"), F.sum("total_trades").alias("total_trades"),
    )
    sizes = F.create_map(*[x for k, v in sets.items() for x in (F.lit(k), F.lit(len(v)))])
    out = ev.evaluate(scored, "model").join(money, "model").withColumn("feature_count", F.element_at(sizes, F.col("model")))
    first = Window.orderBy("model").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # five rows
    return out.withColumns(
        {f"delta_{c}": F.col(c) - F.first(c).over(first) for c in ("accuracy", "sharpe_ratio", "total_return")}
    ).withColumnRenamed("model", "config_id")


# -- folds, stacking --------------------------------------------------------------


def date_folds(rows: DataFrame) -> DataFrame:
    """Numbers the distinct days of a panel so that fold tables apply to days (one row per day)."""
    days = rows.select("trade_date").distinct()
    return days.select(
        F.lit("ALL").alias("symbol"), "trade_date",
        (F.row_number().over(Window.orderBy("trade_date")) - 1).alias("row_no"),
    )


def _fold_list(folds: DataFrame) -> list[dict]:
    """Fold bounds on the driver: a handful of rows."""
    return [r.asDict() for r in folds.orderBy("fold").collect()]


def out_of_fold(rows: DataFrame, specs: dict[str, tuple[str, list[str]]], folds: DataFrame, target: str = TARGET,
                params: Params = Params()) -> DataFrame:
    """(symbol, trade_date, fold, y, one probability per base model) over all validation blocks.

    ``rows`` should be a written table (see ``split_by_date``): every fold reads it.
    """
    return _out_of_fold(rows, specs, folds, target, params, [])[0]


def _out_of_fold(rows: DataFrame, specs: dict[str, tuple[str, list[str]]], folds: DataFrame, target: str, params: Params,
                 beside: list[tuple]) -> tuple[DataFrame, list]:
    """The out-of-fold table and the models of further arguments of ``fit``, fitted beside those of the folds."""
    rows = rows.join(date_folds(rows).select("trade_date", "row_no"), "trade_date")
    out, i, bounds = None, F.col("row_no"), _fold_list(folds)
    trains = [rows.filter((i >= f["train_start"]) & (i < f["train_end"])) for f in bounds]
    found = fit_all([*beside, *((kind, train, features, target, params) for train in trains for kind, features in specs.values())])
    models = iter(found[len(beside):])
    for f in bounds:
        held = rows.filter((i >= f["test_start"]) & (i < f["test_end"])).withColumn("fold", F.lit(f["fold"]))
        for name in specs:
            held = score(next(models), held).withColumnRenamed("p", f"p_{name}").drop("pred")
        part = _xy(held, target).select("symbol", "trade_date", "fold", "y", *[f"p_{n}" for n in specs])
        out = part if out is None else out.unionByName(part)
    return out, found[: len(beside)]


@dataclass
class Stack:
    """Fitted base models with a logistic blend and grid weights over their probabilities."""

    specs: dict[str, tuple[str, list[str]]]
    base: dict[str, PipelineModel | Boosted]
    meta: PipelineModel
    weights: dict[str, float]

    def probabilities(self, rows: DataFrame) -> DataFrame:
        out = rows
        for name, model in self.base.items():
            out = score(model, out).withColumnRenamed("p", f"p_{name}").drop("pred")
        return out

    def score(self, rows: DataFrame, blend: str = "logistic") -> DataFrame:
        out = self.probabilities(rows)
        if blend == "logistic":
            return score(self.meta, out)
        mix = sum((F.col(f"p_{n}") * w for n, w in self.weights.items()), F.lit(0.0))
        p = F.greatest(F.least(mix, F.lit(1.0 - 1e-6)), F.lit(1e-6))
        return out.withColumn("p", p).withColumn("pred", F.when(p >= 0.5, 1.0).otherwise(0.0))


def stack_specs(available: list[str], technical: list[str], price_kind: str = "boosted") -> dict[str, tuple[str, list[str]]]:
    """Price, news and macro specialists; a modality without columns falls back to the price columns."""
    have = set(available)
    tech = [c for c in technical if c in have] or [c for c in available if c not in NEWS_FEATURES]
    news = [c for c in NEWS_FEATURES if c in have] or tech
    macro = [c for c in [*MACRO_FEATURES, *INTERACTIONS] if c in have] or tech
    return {"price": (price_kind, tech), "news": ("logistic", news), "macro": ("logistic", macro)}


def fit_stack(train: DataFrame, specs: dict[str, tuple[str, list[str]]], target: str = TARGET, splits: int = 4,
              params: Params = Params()) -> Stack:
    """Out-of-fold probabilities train the blend; the base models are fitted on all rows beside those of the folds."""
    from marketloom.plans.split import expanding_oof_folds, row_counts

    folds = expanding_oof_folds(row_counts(date_folds(train)), splits)
    every = [(kind, train, features, target, params) for kind, features in specs.values()]
    oof, base = _out_of_fold(train, specs, folds, target, params, every)
    oof = cut_lineage(oof)
    names = [f"p_{n}" for n in specs]
    best = ev.ensemble_weights(oof, names).first()
    meta = fit("logistic", oof, names, "y", params)
    return Stack(specs, dict(zip(specs, base)), meta, {n: best[f"weight_p_{n}"] for n in specs})


def walk_forward_signals(rows: DataFrame, features: list[str], folds: DataFrame, kind: str = "logistic",
                         target: str = TARGET, params: Params = Params()) -> DataFrame:
    """Out-of-sample 0/1 signals over the folds; days before the first test and embargo days give 0."""
    scored = cut_lineage(out_of_fold(rows, {"model": (kind, features)}, folds, target, params))
    hits = scored.select("symbol", "trade_date", F.when(F.col("p_model") > 0.5, 1.0).otherwise(0.0).alias("_s"))
    start = scored.agg(F.min("trade_date")).scalar()
    locks = [F.col(c) if c in rows.columns else F.lit(False).alias(c) for c in ("is_upper_lock", "is_lower_lock")]
    return rows.filter(F.col("trade_date") >= start).select("symbol", "trade_date", "close", *locks).join(
        hits, ["symbol", "trade_date"], "left"
    ).withColumn("signal", F.coalesce("_s", F.lit(0.0))).withColumn("strategy", F.lit(f"walk_forward_{kind}")).drop("_s")


# -- forward scoring --------------------------------------------------------------


def forward_predictions(features_df: DataFrame, features: list[str], kind: str = "boosted", target: str = TARGET,
                        params: Params = Params(), weekdays_only: bool = False) -> DataFrame:
    """Scores the newest session of every symbol with a model of all earlier labelled rows."""
    spark = features_df.sparkSession
    features_df = cut_lineage(features_df)
    train = features_df.na.drop(subset=[*features, target])
    model = fit(kind, train, features, target, params)
    last = cut_lineage(features_df.groupBy("symbol").agg(
        F.max_by(F.struct("trade_date", *features), "trade_date").alias("_r")
    ).select("symbol", "_r.*")).na.drop(subset=features)
    calendar = Calendar().covering(last, F.col("trade_date")).select(F.col("day").alias("trade_date"), "next_trading")
    day = F.col("trade_date")
    skip = F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1)
    drivers = drivers_json(importances(model, features, spark, 5))
    p = F.round("p", 4)
    return score(model, last.join(calendar, "trade_date")).select(
        F.uuid().alias("prediction_id"), "symbol", F.current_timestamp().alias("generated_at"),
        (F.date_add(day, skip) if weekdays_only else F.col("next_trading")).alias("target_date"),
        F.lit(kind).alias("model_name"), F.lit("1.0.0").alias("model_version"), p.alias("up_probability"),
        F.lit(None).cast("double").alias("expected_return"), rg.signal_of(F.col("p")).alias("signal"),
        F.round(rg.confidence_of(F.col("p")), 4).alias("confidence"), F.lit("1.0.0").alias("feature_version"),
        F.lit(drivers).alias("drivers_json"), F.lit(None).cast("double").alias("realized_outcome"),
        F.lit(None).cast("boolean").alias("is_correct"),
    )
