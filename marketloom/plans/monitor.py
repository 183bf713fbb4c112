"""Calibration, drift and health reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.windows import per_symbol

BINS = 10
EDGES = [i / BINS for i in range(1, BINS)]
EPS = 1e-4


def squared_error(p: Column, y: Column) -> Column:
    return F.pow(F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)) - y, 2)


def brier(scored: DataFrame, *by: str) -> DataFrame:
    """Mean squared error of p against y; 0 on empty input."""
    return scored.groupBy(*by).agg(
        F.coalesce(F.avg(squared_error(F.col("p"), F.col("y"))), F.lit(0.0)).alias("brier_score"),
        F.count(F.lit(1)).alias("samples"),
    )


def bin_of(p: Column) -> Column:
    """Index among equal bins by comparison with the literal edges; the last bin is closed."""
    return reduce(lambda a, e: a + F.when(p >= e, 1).otherwise(0), EDGES, F.lit(0))


def reliability_bins(scored: DataFrame, *by: str) -> DataFrame:
    """Count, mean p and observed rate for all ten bins of each group; empty bins show the mid-point."""
    aggs = []
    for i in range(BINS):
        here = F.col("_b") == i
        aggs.append(
            F.struct(
                F.lit(i).alias("bin"), F.count_if(here).alias("count"),
                F.coalesce(F.avg(F.when(here, F.col("p"))), F.lit((i + 0.5) / BINS)).alias("mean_p"),
                F.coalesce(F.avg(F.when(here, F.col("y"))), F.lit(0.0)).alias("rate"),
            )
        )
    inside = scored.filter((F.col("p") >= 0) & (F.col("p") <= 1)).withColumn("_b", bin_of(F.col("p")))
    rows = inside.groupBy(*by).agg(F.array(*aggs).alias("_bins"))
    return rows.select(*by, F.explode("_bins").alias("b")).select(*by, "b.*")


def calibration_error(bins: DataFrame, *by: str) -> DataFrame:
    gap = F.col("count") * F.abs(F.col("rate") - F.col("mean_p"))
    return bins.groupBy(*by).agg(F.coalesce(F.try_divide(F.sum(gap), F.sum("count")), F.lit(0.0)).alias("ece"))


def resolved_scores(registry: DataFrame) -> DataFrame:
    """(symbol, target_date, p, y) of resolved predictions."""
    return registry.filter("realized_outcome IS NOT NULL").select(
        "symbol", "target_date", F.col("up_probability").alias("p"),
        F.when(F.col("realized_outcome") > 0, 1.0).otherwise(0.0).alias("y"),
    )


def rolling_brier(scored: DataFrame) -> DataFrame:
    """Overall, 30-day and 90-day Brier relative to the newest target date; too few rows give null."""
    newest = scored.agg(F.max("target_date")).scalar()
    err = squared_error(F.col("p"), F.col("y"))
    d30 = F.col("target_date") >= F.date_sub(F.col("_newest"), 30)
    d90 = F.col("target_date") >= F.date_sub(F.col("_newest"), 90)
    return scored.withColumn("_newest", newest).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.avg(err), F.lit(0.0)).alias("brier_score"),
        F.when(F.count_if(d30) >= 5, F.avg(F.when(d30, err))).alias("brier_30d"),
        F.when(F.count_if(d90) >= 10, F.avg(F.when(d90, err))).alias("brier_90d"),
    )


def calibration_report(scored: DataFrame) -> DataFrame:
    ece = calibration_error(reliability_bins(scored)).scalar()
    out = rolling_brier(scored).withColumn("ece", F.coalesce(ece, F.lit(0.0)))
    used = F.coalesce("brier_30d", "brier_score")
    return out.withColumn(
        "status",
        F.when(F.col("samples") == 0, "HEALTHY")
        .when((used >= 0.28) | (F.col("ece") >= 0.20), "SEVERE_MISCALIBRATION")
        .when((used >= 0.22) | (F.col("ece") >= 0.10), "MODERATE_MISCALIBRATION")
        .otherwise("HEALTHY"),
    )


# -- drift ------------------------------------------------------------------------


def recent_and_reference(features: DataFrame, recent: int = 60, reference: int = 250, slack: int = 20) -> DataFrame:
    """Last ``recent`` rows per symbol as current, the ``reference`` before them as baseline."""
    newest_first = Window.partitionBy("symbol").orderBy(F.desc("trade_date"))
    rn = F.row_number().over(newest_first)
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol"))
    d = features.withColumns({"_rn": rn, "_n": n}).filter(
        (F.col("_n") >= recent + slack) & (F.col("_rn") <= recent + reference)
    )
    return d.withColumn("role", F.when(F.col("_rn") <= recent, "cur").otherwise("ref")).drop("_rn", "_n")


def numeric_columns(table: DataFrame) -> list[str]:
    """All numeric columns, in the table's order."""
    return [f.name for f in table.schema if isinstance(f.dataType, T.NumericType)]


def long_values(sliced: DataFrame, features: list[str]) -> DataFrame:
    """(symbol, feature, role, x): finite values only, after the slice has bounded the rows."""
    cols = [F.col(c).cast("double").alias(c) for c in features]
    long = sliced.select("symbol", "role", *cols).unpivot(["symbol", "role"], features, "feature", "x")
    return long.filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))


GROUP = ["symbol", "feature"]


def psi(values: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per (symbol, feature) over quantile bins of the reference rows."""
    is_ref = F.col("role") == "ref"
    x = F.when(is_ref, F.col("x"))
    cuts = values.groupBy(*GROUP).agg(
        F.percentile(x, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("_q"),
        F.var_pop(x).alias("_var"),
        F.count_if(is_ref).alias("n_ref"), F.count_if(~is_ref).alias("n_cur"),
    ).withColumn("_cut", F.array_distinct("_q"))
    placed = values.join(cuts.select(*GROUP, "_cut"), GROUP).withColumn(
        "_bin", F.size(F.filter("_cut", lambda e: e <= F.col("x")))
    )
    counts = placed.groupBy(*GROUP).agg(
        F.array(*[F.count_if(is_ref & (F.col("_bin") == i)) for i in range(bins)]).alias("_r"),
        F.array(*[F.count_if(~is_ref & (F.col("_bin") == i)) for i in range(bins)]).alias("_c"),
    )
    d = counts.join(cuts, GROUP)

    def share(counts_col: str, total: str) -> Column:
        used = F.slice(counts_col, F.lit(1), F.size("_cut") + 1)
        return F.transform(used, lambda k: F.greatest(F.coalesce(F.try_divide(k, F.col(total)), F.lit(0.0)), F.lit(EPS)))

    def total(c: str) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, b: a + b)

    d = d.withColumns({"_p": share("_r", "n_ref"), "_a": share("_c", "n_cur")})
    d = d.withColumns({"_ps": total("_p"), "_as": total("_a")})
    terms = F.zip_with(
        "_p", "_a",
        lambda p, a: (a / F.col("_as") - p / F.col("_ps")) * F.ln((a / F.col("_as")) / (p / F.col("_ps"))),
    )
    value = F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))
    flat = (F.col("n_ref") == 0) | (F.col("n_cur") == 0) | (F.col("_var") <= 1e-8)
    return d.select(*GROUP, "n_ref", "n_cur", F.when(flat, 0.0).otherwise(value).alias("psi"))


def ks(values: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and asymptotic p-value per (symbol, feature).

    Equal values are summed first (map-side); the running shares then need one row per
    distinct value of a sliced sample.
    """
    per_value = values.groupBy(*GROUP, "x").agg(
        F.count_if(F.col("role") == "ref").alias("_r"), F.count_if(F.col("role") == "cur").alias("_c")
    )
    run = Window.partitionBy(*GROUP).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*GROUP)
    steps = per_value.withColumns(
        {
            "_fr": F.try_divide(F.sum("_r").over(run), F.sum("_r").over(whole)),
            "_fc": F.try_divide(F.sum("_c").over(run), F.sum("_c").over(whole)),
        }
    )
    out = steps.groupBy(*GROUP).agg(
        F.coalesce(F.max(F.abs(F.col("_fr") - F.col("_fc"))), F.lit(0.0)).alias("ks_stat"),
        F.sum("_r").alias("_n1"), F.sum("_c").alias("_n2"),
    )
    lam2 = F.pow("ks_stat", 2) * F.coalesce(
        F.try_divide(F.col("_n1") * F.col("_n2"), F.col("_n1") + F.col("_n2")), F.lit(0.0)
    )
    series = reduce(
        lambda a, k: a + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * lam2), range(1, 101), F.lit(0.0)
    )
    p = F.when(lam2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))
    return out.select(*GROUP, "ks_stat", p.alias("ks_p_value"))


def feature_drift(values: DataFrame) -> DataFrame:
    """PSI, KS and status per (symbol, feature); thin samples are skipped."""
    enough = psi(values).filter((F.col("n_ref") >= 10) & (F.col("n_cur") >= 5))
    status = F.when(F.col("psi") >= 0.25, "ALERT").when(F.col("psi") >= 0.10, "WARNING").otherwise("STABLE")
    return enough.withColumn("status", status).join(ks(values), GROUP)


def drift_summary(drift: DataFrame) -> DataFrame:
    """Per symbol: counts per status, overall status, retraining flag."""
    n = {s: F.count_if(F.col("status") == s) for s in ("STABLE", "WARNING", "ALERT")}
    agg = drift.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("total_features"), *[c.alias(f"{s.lower()}_features") for s, c in n.items()]
    )
    alarm = (F.col("alert_features") > 0) | (F.col("warning_features") / F.col("total_features") > 0.4)
    overall = F.when(alarm, "ALERT").when(F.col("warning_features") > 0, "WARNING").otherwise("STABLE")
    return agg.withColumn("overall_status", overall).withColumn("retraining_recommended", F.col("overall_status") == "ALERT")


#: Places to which PSI is rounded before it ranks: the last bits depend on the order of sums.
RANK_DIGITS = 6


def _by_psi():
    return F.round("psi", RANK_DIGITS).desc()


def top_drifting(drift: DataFrame, n: int = 10) -> DataFrame:
    """The n features with the highest PSI (to ``RANK_DIGITS`` places, then by name) of each symbol."""
    w = Window.partitionBy("symbol").orderBy(_by_psi(), "feature")
    return drift.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


# -- health -----------------------------------------------------------------------


def feed_freshness(universe: DataFrame, bars: DataFrame, as_of: Column) -> DataFrame:
    """Per enabled symbol: latest date, stale flag (> 5 days or missing), count of gaps > 4 days."""
    gap = F.datediff("trade_date", F.lag("trade_date").over(per_symbol()))
    per = bars.select("symbol", "trade_date", (gap > 4).alias("_gap")).groupBy("symbol").agg(
        F.max("trade_date").alias("latest_date"), F.count_if("_gap").alias("gaps")
    )
    stale = F.col("latest_date").isNull() | (F.datediff(as_of, F.col("latest_date")) > 5)
    return universe.filter("enabled").select("symbol").join(per, "symbol", "left").select(
        "symbol", "latest_date", F.coalesce("gaps", F.lit(0)).alias("gaps"), stale.alias("is_stale")
    )


def feed_summary(freshness: DataFrame) -> DataFrame:
    stale, total = F.col("stale_symbols"), F.col("total_symbols")
    return freshness.agg(
        F.count(F.lit(1)).alias("total_symbols"), F.count_if(~F.col("is_stale")).alias("healthy_symbols"),
        F.count_if("is_stale").alias("stale_symbols"), F.count_if(F.col("gaps") > 0).alias("symbols_with_gaps"),
        F.max("latest_date").alias("latest_date"),
    ).withColumn(
        "status",
        F.when(stale == total, "CRITICAL")
        .when((stale > 0) | (F.col("symbols_with_gaps") > 0), "DEGRADED")
        .otherwise("HEALTHY"),
    )


def model_health(registry: DataFrame) -> DataFrame:
    """Audit totals with the calibration status and the resulting health."""
    done = F.col("realized_outcome").isNotNull()
    totals = registry.agg(
        F.count(F.lit(1)).alias("total_predictions"), F.count_if(done).alias("resolved_predictions"),
        F.coalesce(F.avg(F.when(done, F.col("is_correct").cast("double"))), F.lit(0.0)).alias("hit_rate"),
    )
    status = calibration_report(resolved_scores(registry)).select("status").scalar()
    out = totals.withColumn("calibration_status", F.when(F.col("total_predictions") == 0, "NO_DATA").otherwise(status))
    weak = (F.col("resolved_predictions") >= 10) & (F.col("hit_rate") < 0.45)
    return out.withColumn(
        "status",
        F.when(F.col("calibration_status") == "SEVERE_MISCALIBRATION", "CRITICAL")
        .when((F.col("calibration_status") == "MODERATE_MISCALIBRATION") | weak, "DEGRADED")
        .otherwise("HEALTHY"),
    )


def drift_rollup(drift: DataFrame) -> DataFrame:
    """Universe view: symbols per overall status and the resulting health."""
    s = drift_summary(drift)
    out = s.agg(
        F.count(F.lit(1)).alias("symbols_evaluated"),
        F.count_if(F.col("overall_status") == "ALERT").alias("symbols_alerting"),
        F.count_if(F.col("overall_status") == "WARNING").alias("symbols_warning"),
        *[F.array_sort(F.collect_list(F.when(F.col("overall_status") == s, F.col("symbol")))).alias(n)
          for s, n in (("ALERT", "alerting_symbols"), ("WARNING", "warning_symbols"))],  # one row per symbol
    )
    return out.withColumn(
        "status",
        F.when(F.col("symbols_alerting") > 0, "CRITICAL").when(F.col("symbols_warning") > 0, "DEGRADED").otherwise("HEALTHY"),
    )


def top_drifting_overall(drift: DataFrame, per_symbol_n: int = 3, n: int = 5) -> DataFrame:
    """Highest-PSI features among each symbol's top three (a top-n report)."""
    return top_drifting(drift, per_symbol_n).select("symbol", "feature", "psi", "status").orderBy(
        _by_psi(), "symbol", "feature"
    ).limit(n)


def system_health(feed: DataFrame, model: DataFrame, drift: DataFrame) -> DataFrame:
    """Worst of the three parts with the advice that follows from them."""
    parts = (
        feed.select(F.lit("feed").alias("part"), "status")
        .unionByName(model.select(F.lit("model").alias("part"), "status"))
        .unionByName(drift.select(F.lit("drift").alias("part"), "status"))
    )
    level = F.when(F.col("status") == "CRITICAL", 2).when(F.col("status") == "DEGRADED", 1).otherwise(0)

    def of(part: str) -> Column:
        return F.max(F.when(F.col("part") == part, level))

    agg = parts.agg(F.max(level).alias("_worst"), of("feed").alias("_f"), of("model").alias("_m"), of("drift").alias("_d"))
    advice = F.array_compact(
        F.array(
            F.when(F.col("_f") > 0, "Refresh stale price feeds."),
            F.when(F.col("_m") == 2, "Recalibrate model probabilities."),
            F.when(F.col("_d") == 2, "Retrain: significant feature drift."),
        )
    )
    return agg.select(
        F.when(F.col("_worst") == 2, "CRITICAL").when(F.col("_worst") == 1, "DEGRADED").otherwise("HEALTHY").alias("overall_status"),
        F.when(F.size(advice) == 0, F.array(F.lit("All systems operational."))).otherwise(advice).alias("recommendations"),
    )
