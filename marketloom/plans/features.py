"""The merged feature matrix: technical, news, macro and interaction columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.indicators import TECHNICAL, technical_features
from marketloom.functions.targets import prediction_targets
from marketloom.operators.asof import asof_backward
from marketloom.plans.macro import MACRO_FEATURES
from marketloom.plans.news import NEWS_FEATURES

INTERACTIONS = ["rel_kse100_ret_1d", "policy_rate_spread", "real_interest_rate"]
GROUPS = {"technical": TECHNICAL, "news": NEWS_FEATURES, "macro": MACRO_FEATURES, "interaction": INTERACTIONS}


def build_features(bars: DataFrame, targets: bool = True) -> DataFrame:
    out = technical_features(bars)
    return prediction_targets(out) if targets else out


def feature_manifest(features: DataFrame) -> DataFrame:
    """Per symbol: rows, indicator count, span, status."""
    count = sum(c in features.columns for c in TECHNICAL)
    return features.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("records"),
        F.lit(count).alias("features"),
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("last_date"),
        F.lit("SUCCESS").alias("status"),
    )


def merge_news(features: DataFrame, news: DataFrame | None) -> DataFrame:
    """Left join on (symbol, session); a missing table or row counts as zero."""
    base = features.withColumn("session_date", F.col("trade_date"))
    if news is None:
        return base.withColumns({c: F.lit(0.0) for c in NEWS_FEATURES})
    cols = [F.col(c).cast("double").alias(c) for c in NEWS_FEATURES]
    joined = base.join(news.select("symbol", "session_date", *cols), ["symbol", "session_date"], "left")
    return joined.fillna(0.0, NEWS_FEATURES)


def merge_macro(features: DataFrame, macro: DataFrame | None) -> DataFrame:
    """Latest macro row at or before each session.

    The as-of runs once over the distinct session dates, not per symbol, and the
    result joins back on the date alone.
    """
    if macro is None:
        return features.withColumns({c: F.lit(0.0) for c in MACRO_FEATURES})
    era = F.lit(0).alias("_all")
    dated = asof_backward(
        features.select("session_date").distinct().withColumn("_all", era),
        macro.select(F.col("session_date").alias("_macro_date"), *MACRO_FEATURES).withColumn("_all", era),
        ["_all"], "session_date", "_macro_date", MACRO_FEATURES,
    ).drop("_all")
    return features.join(dated, "session_date", "left").fillna(0.0, MACRO_FEATURES)


def interactions(df: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "rel_kse100_ret_1d": F.coalesce(F.col("return_1d") - F.col("kse100_return_1d"), zero),
            "policy_rate_spread": F.coalesce(F.col("kibor_6m") - F.col("sbp_policy_rate"), zero),
            "real_interest_rate": F.coalesce(F.col("sbp_policy_rate") - F.col("cpi_yoy"), zero),
        }
    )


def merge_all(features: DataFrame, news: DataFrame | None = None, macro: DataFrame | None = None) -> DataFrame:
    return interactions(merge_macro(merge_news(features, news), macro))


def merge_report(universe: DataFrame, merged: DataFrame) -> DataFrame:
    """Per requested symbol: rows, columns per modality, span; SKIPPED where no bars exist."""
    width = {k: sum(c in merged.columns for c in v) for k, v in GROUPS.items()}
    other = len(merged.columns) - width["news"] - width["macro"] - width["interaction"]
    got = merged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("records"),
        F.min("session_date").alias("first_session"),
        F.max("session_date").alias("last_session"),
    )
    ok = F.col("records").isNotNull()
    return universe.select("symbol").join(got, "symbol", "left").select(
        "symbol",
        F.when(ok, "SUCCESS").otherwise("SKIPPED").alias("status"),
        F.coalesce("records", F.lit(0)).alias("records"),
        F.when(ok, other).otherwise(0).alias("technical_columns"),
        F.when(ok, width["news"]).otherwise(0).alias("news_columns"),
        F.when(ok, width["macro"]).otherwise(0).alias("macro_columns"),
        F.when(ok, width["interaction"]).otherwise(0).alias("interaction_columns"),
        "first_session",
        "last_session",
    )
