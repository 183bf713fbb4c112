"""Baselines, train-only scaling and classifier evaluation as grouped aggregates."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.targets import NOISE_BAND
from marketloom.session import cut_lineage

SMOOTH = 1e-4


# -- baselines --------------------------------------------------------------------


def majority_class(train: DataFrame, *by: str) -> DataFrame:
    """Most frequent class per group (lowest on a tie) and the class shares."""
    counts = train.groupBy(*by, "y").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(
        F.max_by("y", F.struct(F.col("_n"), -F.col("y"))).alias("majority"),
        F.sum("_n").alias("n_train"),
        F.map_from_entries(F.collect_list(F.struct("y", "_n"))).alias("_c"),
    ).withColumn("priors", F.transform_values("_c", lambda _, n: n / F.col("n_train"))).drop("_c")


def persistence(ret: Column, three_class: bool = False) -> Column:
    """Repeats the direction of the last return."""
    if three_class:
        return F.when(ret > NOISE_BAND, 1.0).when(ret < -NOISE_BAND, -1.0).otherwise(0.0)
    return F.when(ret > 0, 1.0).otherwise(0.0)


def crossover(fast: Column, slow: Column) -> Column:
    return F.when(fast > slow, 1.0).otherwise(0.0)


def hard_probability(pred: Column, cls: float, classes: int = 2) -> Column:
    """Probability of a class for a rule that is always sure, smoothed and renormalised."""
    total = (1.0 - SMOOTH) + (classes - 1) * SMOOTH
    return F.when(pred == cls, (1.0 - SMOOTH) / total).otherwise(SMOOTH / total)


def standardise(rows: DataFrame, features: list[str], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Scale with mean and population deviation of the training rows only; constants divide by 1."""
    train = rows.filter("role = 'train'").groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in features], *[F.stddev_pop(c).alias(f"_s_{c}") for c in features]
    )
    out = rows.join(train, list(by))
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0) for c in features
    }
    return out.withColumns(scaled).select(*rows.columns)


# -- metrics ----------------------------------------------------------------------


def confusion(scored: DataFrame, *by: str) -> DataFrame:
    return scored.groupBy(*by, "y", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Accuracy and macro precision, recall, F1 (0 on an empty divisor) from the confusion table."""
    c = confusion(scored, *by)
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("y").alias("cls"), hit.alias("tp"), F.lit(0).cast("bigint").alias("said"), F.col("n").alias("true")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("said"), F.lit(0).cast("bigint").alias("true")),
    )
    per_class = c.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.cls").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.said").alias("said"), F.sum("s.true").alias("true")
    )
    zero = F.lit(0.0)
    p, rc = F.coalesce(F.try_divide("tp", "said"), zero), F.coalesce(F.try_divide("tp", "true"), zero)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("said") + F.col("true")), zero)
    return per_class.groupBy(*by).agg(
        F.sum("true").alias("n_test"),
        (F.sum("tp") / F.sum("true")).alias("accuracy"),
        F.avg(p).alias("precision_macro"),
        F.avg(rc).alias("recall_macro"),
        F.avg(f1).alias("f1_macro"),
    )


def auc(scored: DataFrame, *by: str, fanout: int = 4096) -> DataFrame:
    """Exact rank-sum ROC-AUC of ``p`` in [0, 1] for ``y = 1`` per group; null with one class only.

    Scores are first counted per distinct value (map-side). The running total of
    negatives below a score is then taken in three levels: over coarse score cells, over
    the fine cells of a coarse one (each at most ``fanout`` rows) and inside a fine cell.
    So one group with very many distinct scores, even crowded ones, is not ordered by a
    single task.
    """
    keys = list(by)
    coarse, fine = F.floor(F.col("p") * fanout), F.floor(F.col("p") * float(fanout * fanout))
    per_score = scored.groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("_pos"), F.count_if(F.col("y") != 1).alias("_neg")
    ).withColumns({"_c": coarse, "_f": fine})

    def below(*cells: str, order: str):
        before = Window.partitionBy(*keys, *cells).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("_neg").over(before), F.lit(0))

    totals = [F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")]
    whole = Window.partitionBy(*keys)
    by_fine = per_score.groupBy(*keys, "_c", "_f").agg(*totals)
    by_coarse = by_fine.groupBy(*keys, "_c").agg(*totals).select(
        *keys, "_c", below(order="_c").alias("_u1"),
        F.sum("_pos").over(whole).alias("_P"), F.sum("_neg").over(whole).alias("_N"),
    )
    by_fine = by_fine.select(*keys, "_c", "_f", below("_c", order="_f").alias("_u2"))
    ranked = (
        per_score.withColumn("_u3", below("_f", order="p"))
        .join(by_fine, [*keys, "_c", "_f"])
        .join(by_coarse, [*keys, "_c"])
    )
    wins = F.col("_pos") * (F.col("_u1") + F.col("_u2") + F.col("_u3") + F.col("_neg") / 2.0)
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(wins), F.max("_P").cast("double") * F.max("_N")).alias("roc_auc")
    )


def auc_ovr(scored: DataFrame, classes: list[float], *by: str) -> DataFrame:
    """Mean one-vs-rest AUC; ``probs`` holds one probability per class in list order."""
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("cls"), F.get("probs", F.lit(i)).alias("p"), (F.col("y") == c).cast("double").alias("y"))
            for i, c in enumerate(classes)
        ]
    )
    flat = scored.select(*by, F.explode(parts).alias("o")).select(*by, "o.cls", "o.p", "o.y")
    return auc(flat, *by, "cls").groupBy(*by).agg(F.avg("roc_auc").alias("roc_auc"))


def evaluate(scored: DataFrame, *by: str) -> DataFrame:
    """All binary metrics per group of ``by``: needs y, pred and p (probability of class 1)."""
    squares = scored.groupBy(*by).agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_score"))
    return class_metrics(scored, *by).join(auc(scored, *by), list(by), "left").join(squares, list(by), "left")


# -- ensemble weights -------------------------------------------------------------


#: Probabilities are kept this far from 0 and 1 before they are blended.
CLIP = 1e-6


def _mixture_sums(likelihoods: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass of map-side sums: mean likelihood over the blend by model, its products by pairs of models, log loss.

    A mean times the model's weight is its mean responsibility.
    """
    k = len(weights)
    mix = reduce(lambda a, b: a + b, [F.col("_l")[i] * float(w) for i, w in enumerate(weights)])
    share = likelihoods.select(mix.alias("_mix"), "_l").select(F.ln("_mix").alias("_ln"), *[(F.col("_l")[i] / F.col("_mix")).alias(f"_s{i}") for i in range(k)])
    row = share.agg(
        F.avg(-F.col("_ln")), *[F.avg(f"_s{i}") for i in range(k)],
        *[F.avg(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(k) for j in range(k)],
    ).first()
    return np.array(row[1 : k + 1], float), np.array(row[k + 1 :], float).reshape(k, k), row[0]


def _leap(weights: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The point of the simplex that is best by slope and curvature, models with a negative weight left out in turn."""
    k = len(weights)
    ridged = curve + np.eye(k) * 1e-12 * np.trace(curve)
    pull = slope + ridged @ weights
    free = np.ones(k, bool)
    best = weights
    for _ in range(4 * k):
        n = int(free.sum())
        system = np.ones((n + 1, n + 1))
        system[:n, :n] = ridged[np.ix_(free, free)]
        system[n, n] = 0.0
        solved = np.linalg.lstsq(system, np.append(pull[free], 1.0), rcond=None)[0]
        best = np.zeros(k)
        best[free] = solved[:n]
        if best.min() < 0:
            free &= best > best.min()
            continue
        gain = np.where(free, 0.0, pull - ridged @ best - solved[n])
        if gain.max() <= 1e-12:
            break
        free[int(gain.argmax())] = True
    return np.maximum(best, 0.0) / np.maximum(best, 0.0).sum()


def mixture_weights(likelihoods: DataFrame, models: int, gap: float = 1e-9, rounds: int = 200) -> tuple[list[float], float | None]:
    """Weights on the simplex with the least log loss, and that loss.

    ``likelihoods`` holds one array ``_l`` a row: the probability each model gave to what came.
    A round is one pass that sums responsibilities and their products; rows are neither
    multiplied nor collected. The next weights are the best point by slope and curvature. Where
    that does not lower the loss, the step of expectation-maximisation (weight times mean
    ratio), which never raises it, is taken. The loss is convex in the weights and at most
    max(mean ratio) - 1 above its optimum: rounds end when that falls to ``gap``, or when
    neither step lowers the loss. Empty table: equal weights, no loss.
    """
    weights = np.full(models, 1.0 / models)
    slope, curve, loss = _mixture_sums(likelihoods, weights)
    if loss is None:
        return weights.tolist(), None
    spent = 1
    while slope.max() - 1.0 > gap and spent < rounds:
        # a hair of every model keeps weights of zero able to grow
        alive = weights * (1 - 1e-6) + 1e-6 / models
        for step in (_leap(weights, slope, curve), alive * slope / (alive @ slope)):
            found = _mixture_sums(likelihoods, step)
            spent += 1
            if found[2] < loss:
                weights, (slope, curve, loss) = step, found
                break
        else:
            break
    return weights.tolist(), loss


def ensemble_weights(oof: DataFrame, models: list[str]) -> DataFrame:
    """Weights of the blend of the models' probabilities with the lowest log loss (one row).

    Rows without y or without the probability of a model are left out; probabilities are
    clipped to [CLIP, 1 - CLIP]. The rows are written once, as arrays of likelihoods.
    """
    p = [F.greatest(F.least(F.col(m), F.lit(1.0 - CLIP)), F.lit(CLIP)) for m in models]
    known = oof.select("y", *models).dropna()
    likelihoods = cut_lineage(known.select(F.array(*[F.when(F.col("y") == 1, c).otherwise(1.0 - c) for c in p]).alias("_l")))
    weights, loss = mixture_weights(likelihoods, len(models))
    schema = ", ".join([*[f"`weight_{m}` double" for m in models], "log_loss double"])
    return oof.sparkSession.createDataFrame([(*weights, loss)], schema)
