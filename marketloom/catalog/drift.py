"""L6-L8 and L12 over the whole technical feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.catalog import fixtures as fx
from marketloom.catalog import indicators as ci
from marketloom.catalog.monitoring import DRIFT, DRIFTSUM, KS_P
from marketloom.catalog.registry import query, r, sr
from marketloom.functions import indicators as ind
from marketloom.plans import monitor as mn
from marketloom.session import cut_lineage

PRICES = ["open", "high", "low", "close", "volume"]
FEATURES = [*PRICES, *ind.TECHNICAL]


def matrix(spark, sf):
    """Bars with every indicator, to the places that C15 shows: equal values fall into equal bins in both engines."""
    df = ind.technical_features(fx.bars(spark, sf))
    return df.select("symbol", "trade_date", *PRICES, *[(F.col(c) if c in ci.RAW else r(c, ci.PLACES.get(c, 6)) + 0.0).alias(c) for c in ind.TECHNICAL])


def values(spark, sf):
    """Values of the recent and the reference days, written once: PSI, KS and the status read them."""
    sliced = mn.recent_and_reference(matrix(spark, sf))
    return cut_lineage(mn.long_values(sliced, mn.numeric_columns(sliced)))


def _ctes() -> str:
    win = {**ci.WINDOWED, **ci.VOLATILITY, **ci.OBV}
    shown = ", ".join(f"{e} AS {c}" for c, e in win.items())
    rec = ", ".join(f"{e} AS {c}" for c, e in ci.RECURSIVE.items())
    names = ", ".join(FEATURES)
    doubles = ", ".join(f"({c})::DOUBLE + 0e0 AS {c}" for c in FEATURES)
    tail = DRIFT[DRIFT.index("cuts AS (") :]
    return ci.EWM + ci.R1 + f""",
matrix AS MATERIALIZED (SELECT symbol, trade_date, {doubles} FROM (SELECT symbol, trade_date, {', '.join(PRICES)}, {shown} FROM r) JOIN (SELECT symbol, trade_date, {rec} FROM rec) USING (symbol, trade_date)),
wide AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS rd, count(*) OVER (PARTITION BY symbol) AS n FROM matrix),
sliced AS (SELECT *, CASE WHEN rd <= 60 THEN 'cur' ELSE 'ref' END AS role FROM wide WHERE n >= 80 AND rd <= 310),
vals AS MATERIALIZED (SELECT symbol, role, feature, x FROM (UNPIVOT (SELECT symbol, role, {names} FROM sliced) ON {names} INTO NAME feature VALUE x) WHERE x IS NOT NULL AND isfinite(x)),
""" + tail


CTES = _ctes()


@query("l6_matrix_stability", fx.sql(CTES, f"SELECT symbol, feature, n_ref, n_cur, {sr('psi')} AS psi FROM psi", recursive=True))
def l6(spark, sf):
    return mn.psi(values(spark, sf)).withColumn("psi", r("psi"))


@query("l7_matrix_ks", fx.sql(CTES, f"""
SELECT symbol, feature, {sr('ks_stat')} AS ks_stat, {sr(f'CASE WHEN l2 < 0.04 THEN 1 ELSE greatest(0, least(1, {KS_P})) END')} AS ks_p_value
FROM (SELECT ks.*, ks_stat * ks_stat * (n_ref * n_cur / (n_ref + n_cur)) AS l2 FROM ks JOIN cuts USING (symbol, feature))""", recursive=True))
def l7(spark, sf):
    return mn.ks(values(spark, sf)).withColumns({"ks_stat": r("ks_stat"), "ks_p_value": r("ks_p_value")})


@query("l8_matrix_drift_summary", fx.sql(CTES, "SELECT *, overall_status = 'ALERT' AS retraining_recommended FROM summ", recursive=True))
def l8(spark, sf):
    return mn.drift_summary(mn.feature_drift(values(spark, sf)))


@query("l8_matrix_top_features", fx.sql(CTES, f"""
SELECT symbol, feature, {sr('psi')} AS psi, status, row_number() OVER (PARTITION BY symbol ORDER BY round(psi, 6) DESC, feature)::INT AS rank FROM drift QUALIFY rank <= 10""", recursive=True))
def l8t(spark, sf):
    return mn.top_drifting(mn.feature_drift(values(spark, sf))).select("symbol", "feature", r("psi").alias("psi"), "status", "rank")


@query("l12_matrix_rollup", fx.sql(CTES + DRIFTSUM, "SELECT * FROM driftsum", recursive=True))
def l12(spark, sf):
    return mn.drift_rollup(mn.feature_drift(values(spark, sf)))
