"""K (registry), L (monitoring) and M (read side)."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog.registry import query, r, sr
from marketloom.plans import monitor as mn
from marketloom.plans import registry as rg
from marketloom.plans import views as vw

DRIVERS = '{"rsi_14":0.5,"obv":-0.25}'


def predictions(spark, sf):
    """One forecast per document: brand by id, target day spread over the bar years, p on a 1/64 grid."""
    d, p = F.col("doc_id"), F.pmod(F.col("n_chars") * 7 + F.col("doc_id"), F.lit(65)) / 64.0
    return fx.table(spark, sf, "documents").select(
        F.concat(F.lit("p-"), d).alias("prediction_id"),
        F.concat(F.lit("BRAND"), d % 25 + 1).alias("symbol"),
        F.expr("TIMESTAMP_NTZ'1997-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id AS INT), 0, 0)").cast("timestamp").alias("generated_at"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.pmod(d * 13, F.lit(2000)).cast("int")).alias("target_date"),
        F.lit("logistic").alias("model_name"), F.lit("1.0.0").alias("model_version"), p.alias("up_probability"),
        F.lit(None).cast("double").alias("expected_return"), rg.signal_of(p).alias("signal"), rg.confidence_of(p).alias("confidence"),
        F.lit("1.0.0").alias("feature_version"), F.when(d % 2 == 0, DRIVERS).otherwise("{}").alias("drivers_json"),
        F.lit(None).cast("double").alias("realized_outcome"), F.lit(None).cast("boolean").alias("is_correct"))


PRED = """
pred AS (
  SELECT *, CASE WHEN p >= 0.52 THEN 'BUY' WHEN p <= 0.48 THEN 'SELL' ELSE 'HOLD' END AS signal, abs(p - 0.5) * 2 AS confidence
  FROM (SELECT 'p-' || doc_id AS prediction_id, doc_id, 'BRAND' || (doc_id % 25 + 1) AS symbol, DATE '1996-01-01' + CAST(doc_id * 13 % 2000 AS INT) AS target_date,
               ((n_chars * 7 + doc_id) % 65) / 64e0 AS p FROM documents))"""
RESOLVED = fx.BARS + "," + PRED + """,
moved AS (SELECT symbol, trade_date AS target_date, (close - pc) / pc AS rr
          FROM (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS pc FROM bars) WHERE pc IS NOT NULL),
res AS (
  SELECT pred.*, CAST(round_even(rr, 6) AS DOUBLE) AS realized_outcome,
         CASE WHEN rr IS NULL THEN NULL WHEN signal = 'BUY' THEN rr > 0 WHEN signal = 'SELL' THEN rr <= 0 ELSE abs(rr) <= 0.0075 END AS is_correct
  FROM pred LEFT JOIN moved USING (symbol, target_date)),
scored AS (SELECT symbol, target_date, p, CASE WHEN realized_outcome > 0 THEN 1e0 ELSE 0e0 END AS y FROM res WHERE realized_outcome IS NOT NULL)"""


def resolved(spark, sf):
    return rg.reconcile(predictions(spark, sf), fx.bars(spark, sf))


@query("k2_registry_append", fx.sql(PRED, "SELECT prediction_id, symbol, p AS up_probability, confidence, signal FROM pred"))
def k2(spark, sf):
    p = predictions(spark, sf)
    return rg.append_predictions(p.filter("up_probability < 0.7"), p.filter("up_probability > 0.3")).select(
        "prediction_id", "symbol", "up_probability", "confidence", "signal")


@query("k3_unresolved_predictions", fx.sql(RESOLVED, "SELECT prediction_id, target_date FROM res WHERE symbol = 'BRAND3' AND realized_outcome IS NULL"))
def k3(spark, sf):
    return rg.find_predictions(resolved(spark, sf), "brand3", unresolved=True).select("prediction_id", "target_date")


@query("k4_registry_update", fx.sql(PRED, """
SELECT prediction_id, CASE WHEN doc_id % 2 = 0 THEN 'v2' ELSE '1.0.0' END AS model_version, p AS up_probability FROM pred"""))
def k4(spark, sf):
    p = predictions(spark, sf)
    changed = p.filter(F.substring_index("prediction_id", "-", -1).cast("bigint") % 2 == 0).withColumn("model_version", F.lit("v2"))
    return rg.merge_rows(p, changed).select("prediction_id", "model_version", "up_probability")


@query("k5_outcome_reconciliation", fx.sql(RESOLVED, "SELECT prediction_id, symbol, target_date, signal, realized_outcome, is_correct FROM res"))
def k5(spark, sf):
    return resolved(spark, sf).select("prediction_id", "symbol", "target_date", "signal", (F.col("realized_outcome") + 0.0).alias("realized_outcome"), "is_correct")


@query("k6_audit_summary", fx.sql(RESOLVED, f"""
SELECT coalesce(symbol, 'ALL') AS symbol, count(*) AS total_records, count(realized_outcome) AS resolved_records, count(*) - count(realized_outcome) AS pending_records,
       {sr('coalesce(avg(is_correct::INT), 0)')} AS hit_rate, {sr('avg(CASE WHEN realized_outcome IS NOT NULL THEN pow(p - (realized_outcome > 0)::INT, 2) END)')} AS brier_score
FROM res GROUP BY GROUPING SETS ((symbol), ())"""))
def k6(spark, sf):
    return rg.audit(resolved(spark, sf)).withColumns({"hit_rate": r("hit_rate"), "brier_score": r("brier_score")})


@query("k7_latest_per_symbol", fx.sql(PRED, """
SELECT symbol, prediction_id, target_date, p AS up_probability, signal, CASE WHEN doc_id % 2 = 0 THEN 0.5e0 END AS rsi_weight FROM pred
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY target_date DESC, doc_id DESC) = 1"""))
def k7(spark, sf):
    return rg.latest_per_symbol(predictions(spark, sf)).select(
        "symbol", "prediction_id", "target_date", "up_probability", "signal", F.element_at("drivers", F.lit("rsi_14")).alias("rsi_weight"))


@query("k8_prediction_listing", fx.sql(PRED, """
SELECT prediction_id, target_date, CASE WHEN p >= 0.5 THEN 'UP' ELSE 'DOWN' END AS label FROM pred ORDER BY target_date DESC, prediction_id LIMIT 50"""))
def k8(spark, sf):
    return rg.listing(predictions(spark, sf)).select("prediction_id", "target_date", "label")


# -- L ----------------------------------------------------------------------------


def scores(spark, sf):
    return mn.resolved_scores(resolved(spark, sf))


@query("l1_brier_score", fx.sql(RESOLVED, f"SELECT symbol, {sr('avg(pow(p - y, 2))')} AS brier_score, count(*) AS samples FROM scored GROUP BY symbol"))
def l1(spark, sf):
    return mn.brier(scores(spark, sf), "symbol").withColumn("brier_score", r("brier_score"))


BINS = RESOLVED + """,
binned AS (SELECT *, least(len(list_filter([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0], lambda e: p >= e)), 9)::INT AS b FROM scored),
rb AS (SELECT symbol, k AS bin, count(p) AS count, coalesce(avg(p), (k + 0.5) / 10) AS mean_p, coalesce(avg(y), 0) AS rate
       FROM (SELECT DISTINCT symbol, unnest(range(0, 10))::INT AS k FROM scored) g LEFT JOIN binned USING (symbol) WHERE b = k OR b IS NULL GROUP BY ALL)"""
BINS_ALL = RESOLVED + """,
binned AS (SELECT *, len(list_filter([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0], lambda e: p >= e))::INT AS b FROM scored),
rb AS (SELECT k AS bin, count(p) AS count, coalesce(avg(p), (k + 0.5) / 10) AS mean_p, coalesce(avg(y), 0) AS rate
       FROM (SELECT unnest(range(0, 10))::INT AS k) LEFT JOIN binned ON b = k GROUP BY k),
ece AS (SELECT sum(count * abs(rate - mean_p)) / sum(count) AS ece FROM rb)"""


@query("l2_reliability_bins", fx.sql(BINS_ALL, f"SELECT bin, count, {sr('mean_p')} AS mean_p, {sr('rate')} AS rate FROM rb"))
def l2(spark, sf):
    return mn.reliability_bins(scores(spark, sf)).withColumns({"mean_p": r("mean_p"), "rate": r("rate")})


@query("l3_expected_calibration_error", fx.sql(RESOLVED + """,
binned AS (SELECT *, len(list_filter([0.1e0, 0.2e0, 0.3e0, 0.4e0, 0.5e0, 0.6e0, 0.7e0, 0.8e0, 0.9e0], lambda e: p >= e)) AS b FROM scored),
g AS (SELECT symbol, b, count(*) AS c, abs(avg(y) - avg(p)) AS gap FROM binned GROUP BY ALL)""", f"""
SELECT symbol, {sr('sum(c * gap) / sum(c)')} AS ece FROM g GROUP BY symbol"""))
def l3(spark, sf):
    return mn.calibration_error(mn.reliability_bins(scores(spark, sf), "symbol"), "symbol").withColumn("ece", r("ece"))


ROLLING = """,
roll AS (SELECT count(*) AS samples, avg(pow(p - y, 2)) AS brier_score,
  CASE WHEN count(*) FILTER (target_date >= m - 30) >= 5 THEN avg(pow(p - y, 2)) FILTER (target_date >= m - 30) END AS brier_30d,
  CASE WHEN count(*) FILTER (target_date >= m - 90) >= 10 THEN avg(pow(p - y, 2)) FILTER (target_date >= m - 90) END AS brier_90d
  FROM scored, (SELECT max(target_date) AS m FROM scored)),
cal AS (SELECT roll.*, ece, CASE WHEN coalesce(brier_30d, brier_score) >= 0.28 OR ece >= 0.2 THEN 'SEVERE_MISCALIBRATION'
  WHEN coalesce(brier_30d, brier_score) >= 0.22 OR ece >= 0.1 THEN 'MODERATE_MISCALIBRATION' ELSE 'HEALTHY' END AS status FROM roll, ece)"""


@query("l4_rolling_brier", fx.sql(BINS_ALL + ROLLING, f"SELECT samples, {sr('brier_score')} AS brier_score, {sr('brier_30d')} AS brier_30d, {sr('brier_90d')} AS brier_90d FROM roll"))
def l4(spark, sf):
    return mn.rolling_brier(scores(spark, sf)).withColumns({c: r(c) for c in ("brier_score", "brier_30d", "brier_90d")})


@query("l5_calibration_status", fx.sql(BINS_ALL + ROLLING, f"SELECT samples, {sr('ece')} AS ece, status FROM cal"))
def l5(spark, sf):
    return mn.calibration_report(scores(spark, sf)).select("samples", r("ece").alias("ece"), "status")


def drift_input(spark, sf):
    from marketloom.operators.windows import per_symbol
    return fx.bars(spark, sf).withColumns({
        "range_pct": (F.col("high") - F.col("low")) / F.col("close"), "change": F.col("close") - F.lag("close").over(per_symbol())})


def drift_values(spark, sf):
    table = drift_input(spark, sf)
    return mn.long_values(mn.recent_and_reference(table), mn.numeric_columns(table))


DRIFT = fx.BARS + """,
wide AS (SELECT symbol, trade_date, open, high, low, close, volume::DOUBLE AS volume, (high - low) / close AS range_pct, close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS change,
         row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rd, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
sliced AS (SELECT *, CASE WHEN rd <= 60 THEN 'cur' ELSE 'ref' END AS role FROM wide WHERE n >= 80 AND rd <= 310),
vals AS (SELECT symbol, role, feature, x FROM (UNPIVOT (SELECT symbol, role, open, high, low, close, volume, range_pct, change FROM sliced) ON open, high, low, close, volume, range_pct, change INTO NAME feature VALUE x) WHERE x IS NOT NULL),
cuts AS (SELECT symbol, feature, list_distinct(quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) FILTER (role = 'ref')) AS q,
         var_pop(x) FILTER (role = 'ref') AS v, count(*) FILTER (role = 'ref') AS n_ref, count(*) FILTER (role = 'cur') AS n_cur FROM vals GROUP BY ALL),
placed AS (SELECT vals.*, len(list_filter(q, lambda e: e <= x)) AS b FROM vals JOIN cuts USING (symbol, feature)),
allbins AS (SELECT symbol, feature, n_ref, n_cur, v, unnest(range(0, len(q) + 1)) AS b FROM cuts),
share AS (SELECT a.symbol, a.feature, a.b, any_value(v) AS v, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur,
          greatest(count(*) FILTER (role = 'ref') / any_value(n_ref), 1e-4) AS p, greatest(count(*) FILTER (role = 'cur') / any_value(n_cur), 1e-4) AS c
          FROM allbins a LEFT JOIN placed USING (symbol, feature, b) GROUP BY a.symbol, a.feature, a.b),
normed AS (SELECT *, p / sum(p) OVER (PARTITION BY symbol, feature) AS pp, c / sum(c) OVER (PARTITION BY symbol, feature) AS cc FROM share),
psi AS (SELECT symbol, feature, any_value(n_ref) AS n_ref, any_value(n_cur) AS n_cur, CASE WHEN any_value(v) <= 1e-8 THEN 0 ELSE greatest(0, sum((cc - pp) * ln(cc / pp) ORDER BY b)) END AS psi FROM normed GROUP BY ALL),
cdf AS (SELECT symbol, feature, x, count(*) FILTER (role = 'ref') OVER w / count(*) FILTER (role = 'ref') OVER t AS f1, count(*) FILTER (role = 'cur') OVER w / count(*) FILTER (role = 'cur') OVER t AS f2
        FROM vals WINDOW w AS (PARTITION BY symbol, feature ORDER BY x RANGE UNBOUNDED PRECEDING), t AS (PARTITION BY symbol, feature)),
ks AS (SELECT symbol, feature, max(abs(f1 - f2)) AS ks_stat FROM cdf GROUP BY ALL),
drift AS (SELECT psi.*, ks_stat, CASE WHEN psi >= 0.25 THEN 'ALERT' WHEN psi >= 0.1 THEN 'WARNING' ELSE 'STABLE' END AS status FROM psi JOIN ks USING (symbol, feature)
          WHERE n_ref >= 10 AND n_cur >= 5),
summ AS (SELECT *, CASE WHEN alert_features > 0 OR warning_features / total_features > 0.4 THEN 'ALERT' WHEN warning_features > 0 THEN 'WARNING' ELSE 'STABLE' END AS overall_status
  FROM (SELECT symbol, count(*) AS total_features, count(*) FILTER (status = 'STABLE') AS stable_features, count(*) FILTER (status = 'WARNING') AS warning_features,
               count(*) FILTER (status = 'ALERT') AS alert_features FROM drift GROUP BY symbol))"""


@query("l6_population_stability", fx.sql(DRIFT, f"SELECT symbol, feature, n_ref, n_cur, {sr('psi')} AS psi FROM psi"))
def l6(spark, sf):
    return mn.psi(drift_values(spark, sf)).withColumn("psi", r("psi"))


KS_P = " + ".join(f"{'' if k % 2 else '-'}2 * exp(-2 * {k * k} * l2)" for k in range(1, 31)).replace("+ -2", "- 2")


@query("l7_ks_two_sample", fx.sql(DRIFT, f"""
SELECT symbol, feature, {sr('ks_stat')} AS ks_stat, {sr(f'CASE WHEN l2 < 0.04 THEN 1 ELSE greatest(0, least(1, {KS_P})) END')} AS ks_p_value
FROM (SELECT ks.*, ks_stat * ks_stat * (n_ref * n_cur / (n_ref + n_cur)) AS l2 FROM ks JOIN cuts USING (symbol, feature))"""))
def l7(spark, sf):
    return mn.ks(drift_values(spark, sf)).withColumns({"ks_stat": r("ks_stat"), "ks_p_value": r("ks_p_value")})


@query("l8_feature_drift_summary", fx.sql(DRIFT, "SELECT *, overall_status = 'ALERT' AS retraining_recommended FROM summ"))
def l8(spark, sf):
    return mn.drift_summary(mn.feature_drift(drift_values(spark, sf)))


@query("l8_top_drifting_features", fx.sql(DRIFT, f"""
SELECT symbol, feature, {sr('psi')} AS psi, status, row_number() OVER (PARTITION BY symbol ORDER BY round(psi, 6) DESC, feature)::INT AS rank FROM drift QUALIFY rank <= 10"""))
def l8t(spark, sf):
    return mn.top_drifting(mn.feature_drift(drift_values(spark, sf))).select("symbol", "feature", r("psi").alias("psi"), "status", "rank")


@query("l9_reference_current_slices", fx.sql(DRIFT, "SELECT symbol, role, count(*) AS row_count, min(trade_date) AS first_date, max(trade_date) AS last_date FROM sliced GROUP BY ALL"))
def l9(spark, sf):
    return mn.recent_and_reference(drift_input(spark, sf)).groupBy("symbol", "role").agg(
        F.count(F.lit(1)).alias("row_count"), F.min("trade_date").alias("first_date"), F.max("trade_date").alias("last_date"))


AS_OF = "2001-11-05"
FEED = """,
fresh AS (SELECT u.symbol, latest_date, coalesce(gaps, 0) AS gaps, latest_date IS NULL OR DATE '2001-11-05' - latest_date > 5 AS is_stale
  FROM universe u LEFT JOIN (SELECT symbol, max(trade_date) AS latest_date, count(*) FILTER (g > 4) AS gaps FROM (
    SELECT symbol, trade_date, trade_date - lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS g FROM bars) GROUP BY symbol) USING (symbol) WHERE enabled),
feedsum AS (SELECT *, CASE WHEN stale_symbols = total_symbols THEN 'CRITICAL' WHEN stale_symbols > 0 OR symbols_with_gaps > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
  FROM (SELECT count(*) AS total_symbols, count(*) FILTER (NOT is_stale) AS healthy_symbols, count(*) FILTER (is_stale) AS stale_symbols,
               count(*) FILTER (gaps > 0) AS symbols_with_gaps, max(latest_date) AS latest_date FROM fresh))"""
MODEL = """,
tot AS (SELECT count(*) AS total_predictions, count(realized_outcome) AS resolved_predictions, coalesce(avg(is_correct::INT), 0) AS hit_rate FROM res),
modelsum AS (SELECT tot.*, cal.status AS calibration_status, CASE WHEN cal.status = 'SEVERE_MISCALIBRATION' THEN 'CRITICAL'
  WHEN cal.status = 'MODERATE_MISCALIBRATION' OR (resolved_predictions >= 10 AND hit_rate < 0.45) THEN 'DEGRADED' ELSE 'HEALTHY' END AS status FROM tot, cal)"""
DRIFTSUM = """,
driftsum AS (SELECT *, CASE WHEN symbols_alerting > 0 THEN 'CRITICAL' WHEN symbols_warning > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS status
  FROM (SELECT count(*) AS symbols_evaluated, count(*) FILTER (overall_status = 'ALERT') AS symbols_alerting, count(*) FILTER (overall_status = 'WARNING') AS symbols_warning,
               coalesce(list(symbol ORDER BY symbol) FILTER (overall_status = 'ALERT'), []) AS alerting_symbols,
               coalesce(list(symbol ORDER BY symbol) FILTER (overall_status = 'WARNING'), []) AS warning_symbols FROM summ))"""


def freshness(spark, sf):
    return mn.feed_freshness(fx.universe(spark, sf), fx.bars(spark, sf), F.lit(AS_OF).cast("date"))


@query("l10_feed_freshness", fx.sql(fx.BARS + "," + fx.UNIVERSE + FEED, "SELECT * FROM fresh"))
def l10(spark, sf):
    return freshness(spark, sf)


@query("l10_feed_summary", fx.sql(fx.BARS + "," + fx.UNIVERSE + FEED, "SELECT * FROM feedsum"))
def l10s(spark, sf):
    return mn.feed_summary(freshness(spark, sf))


@query("l11_model_health", fx.sql(BINS_ALL + ROLLING + MODEL, f"SELECT * REPLACE ({sr('hit_rate')} AS hit_rate) FROM modelsum"))
def l11(spark, sf):
    return mn.model_health(resolved(spark, sf)).withColumn("hit_rate", r("hit_rate"))


@query("l12_universe_drift_rollup", fx.sql(DRIFT + DRIFTSUM, "SELECT * FROM driftsum"))
def l12(spark, sf):
    return mn.drift_rollup(mn.feature_drift(drift_values(spark, sf)))


@query("l12_top_drift_overall", fx.sql(DRIFT, f"""
SELECT symbol, feature, {sr('psi')} AS psi, status FROM (SELECT * FROM drift QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(psi, 6) DESC, feature) <= 3) ORDER BY round(psi, 6) DESC, symbol, feature LIMIT 5"""))
def l12t(spark, sf):
    return mn.top_drifting_overall(mn.feature_drift(drift_values(spark, sf))).withColumn("psi", r("psi"))


@query("l13_system_health", fx.sql(BINS_ALL + ROLLING + MODEL + "," + fx.UNIVERSE + FEED + "," + DRIFT.split("bars GROUP BY symbol, trade_date),\n", 1)[-1].split("GROUP BY symbol, trade_date),", 1)[-1].lstrip() + DRIFTSUM, """
SELECT CASE WHEN 'CRITICAL' IN (f, m, d) THEN 'CRITICAL' WHEN 'DEGRADED' IN (f, m, d) THEN 'DEGRADED' ELSE 'HEALTHY' END AS overall_status,
       coalesce(nullif(concat_ws('|', CASE WHEN f <> 'HEALTHY' THEN 'Refresh stale price feeds.' END, CASE WHEN m = 'CRITICAL' THEN 'Recalibrate model probabilities.' END,
         CASE WHEN d = 'CRITICAL' THEN 'Retrain: significant feature drift.' END), ''), 'All systems operational.') AS recommendations
FROM (SELECT (SELECT status FROM feedsum) AS f, (SELECT status FROM modelsum) AS m, (SELECT status FROM driftsum) AS d)"""))
def l13(spark, sf):
    return mn.system_health(
        mn.feed_summary(freshness(spark, sf)), mn.model_health(resolved(spark, sf)), mn.drift_rollup(mn.feature_drift(drift_values(spark, sf)))
    ).withColumn("recommendations", F.array_join("recommendations", "|"))


# -- M ----------------------------------------------------------------------------


@query("m1_universe_listing", fx.sql(fx.BARS + "," + fx.UNIVERSE, """
SELECT u.*, total_sessions, latest_date, total_sessions IS NOT NULL AS has_data FROM universe u
LEFT JOIN (SELECT symbol, count(*) AS total_sessions, max(trade_date) AS latest_date FROM bars GROUP BY symbol) USING (symbol) WHERE enabled AND lower(sector) = 'economy'"""))
def m1(spark, sf):
    return vw.universe_listing(fx.universe(spark, sf), fx.bars(spark, sf), "Economy", enabled_only=True)


@query("m2_last_sessions", fx.sql(fx.BARS, "SELECT symbol, trade_date, close, volume FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) <= 30"))
def m2(spark, sf):
    return vw.last_sessions(fx.bars(spark, sf)).select("symbol", "trade_date", "close", "volume")


OVERVIEW = fx.BARS + "," + fx.UNIVERSE + "," + PRED + """,
ov AS (SELECT u.symbol, name, sector, last_session, latest_close, change_1d, coalesce(signal, 'N/A') AS signal, p * 100 AS up_probability_pct,
              CASE WHEN last_session IS NULL THEN 'Missing' ELSE 'Ready' END AS data_status
  FROM universe u LEFT JOIN (SELECT symbol, max(trade_date) AS last_session, arg_max(close, trade_date) AS latest_close, arg_max(chg, trade_date) AS change_1d
    FROM (SELECT symbol, trade_date, close, coalesce((close - lag(close) OVER w) / lag(close) OVER w * 100, 0) AS chg FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)) GROUP BY symbol) USING (symbol)
  LEFT JOIN (SELECT symbol, signal, p FROM pred QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY target_date DESC, doc_id DESC) = 1) USING (symbol))"""


def overview(spark, sf):
    return vw.market_overview(fx.universe(spark, sf), fx.bars(spark, sf), predictions(spark, sf))


@query("m3_market_overview", fx.sql(OVERVIEW, f"SELECT * REPLACE ({sr('change_1d')} AS change_1d) FROM ov"))
def m3(spark, sf):
    return overview(spark, sf).withColumn("change_1d", r("change_1d"))


@query("m4_text_search", fx.sql(OVERVIEW, "SELECT symbol, name, sector FROM ov WHERE contains(lower(symbol), 'brand1') OR contains(lower(name), 'brand1')"))
def m4(spark, sf):
    return vw.search(overview(spark, sf), " Brand1 ").select("symbol", "name", "sector")


@query("m5_distributions", fx.sql(OVERVIEW, """
SELECT sector, count(*) AS instruments, count(*) FILTER (signal = 'BUY') AS buy, count(*) FILTER (signal = 'HOLD') AS hold, count(*) FILTER (signal = 'SELL') AS sell FROM ov GROUP BY sector"""))
def m5(spark, sf):
    return vw.distributions(overview(spark, sf))


@query("m7_platform_counters", fx.sql(fx.BARS + "," + fx.UNIVERSE, """
SELECT count(*) AS configured, count(*) FILTER (enabled) AS enabled, count(*) FILTER (symbol IN (SELECT symbol FROM bars)) AS with_data,
       (SELECT count(*) FROM documents) AS predictions FROM universe"""))
def m7(spark, sf):
    return vw.counters(fx.universe(spark, sf), fx.bars(spark, sf), predictions(spark, sf))
