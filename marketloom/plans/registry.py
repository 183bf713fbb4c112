"""Prediction registry: append, query, update, reconcile, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.dedupe import keep_last
from marketloom.operators.windows import per_symbol
from marketloom.schemas import PREDICTIONS

BUY_FROM, SELL_TO, HOLD_BAND = 0.52, 0.48, 0.0075


def signal_of(p: Column) -> Column:
    return F.when(p >= BUY_FROM, "BUY").when(p <= SELL_TO, "SELL").otherwise("HOLD")


def confidence_of(p: Column) -> Column:
    return F.abs(p - 0.5) * 2.0


def refusal() -> Column:
    """Why a prediction is refused; null for one that is kept."""
    p, c = F.col("up_probability"), F.col("confidence")
    outside = lambda x: F.isnan(x) | ~x.between(0, 1)
    return (
        F.when(p.isNull(), "probability missing").when(outside(p), "probability out of range")
        .when(c.isNull(), "confidence missing").when(outside(c), "confidence out of range")
    )


def checked(predictions: DataFrame) -> DataFrame:
    """Rows with probability and confidence in [0, 1]; a missing id is drawn once here."""
    return predictions.filter(refusal().isNull()).withColumn("prediction_id", F.coalesce("prediction_id", F.uuid()))


def refused(predictions: DataFrame) -> DataFrame:
    """The rows that ``checked`` leaves out, with their ``reason``."""
    return predictions.drop("reason").withColumn("reason", refusal()).filter("reason IS NOT NULL")


def merge_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union with later rows winning per id; used for appends and updates.

    Rows of one id and one time are ordered by their other columns, so that the winner is one.
    """
    ties = [c for c in stored.columns if c not in ("prediction_id", "generated_at")]
    both = stored.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)))
    return keep_last(both, ["prediction_id"], ["_rank", "generated_at", *ties]).drop("_rank")


def append_predictions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return merge_rows(stored, checked(incoming)).select(*PREDICTIONS.fieldNames())


def find_predictions(registry: DataFrame, symbol: str | None = None, unresolved: bool = False) -> DataFrame:
    out = registry
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol.strip().upper())
    return out.filter(F.col("realized_outcome").isNull()) if unresolved else out


def reconcile(registry: DataFrame, bars: DataFrame) -> DataFrame:
    """Fill outcome and correctness of unresolved rows whose target session has traded."""
    prev = F.lag("close").over(per_symbol())
    moved = bars.select(
        "symbol", F.col("trade_date").alias("target_date"), F.try_divide(F.col("close") - prev, prev).alias("_r")
    ).filter("_r IS NOT NULL")
    r, signal = F.col("_r"), F.upper("signal")
    right = F.when(signal == "BUY", r > 0).when(signal == "SELL", r <= 0).otherwise(F.abs(r) <= HOLD_BAND)
    fresh = F.col("realized_outcome").isNull() & r.isNotNull()
    return (
        registry.join(moved, ["symbol", "target_date"], "left")
        .withColumn("is_correct", F.when(fresh, right).otherwise(F.col("is_correct")))
        .withColumn("realized_outcome", F.when(fresh, F.bround(r, 6)).otherwise(F.col("realized_outcome")))
        .select(*registry.columns)
    )


def went_up() -> Column:
    return F.when(F.col("realized_outcome") > 0, 1.0).otherwise(0.0)


def audit(resolved: DataFrame) -> DataFrame:
    """Totals, hit rate and Brier per symbol and overall (rollup)."""
    done = F.col("realized_outcome").isNotNull()
    return (
        resolved.rollup("symbol")
        .agg(
            F.count(F.lit(1)).alias("total_records"), F.count_if(done).alias("resolved_records"),
            F.count_if(~done).alias("pending_records"),
            F.coalesce(F.avg(F.when(done, F.col("is_correct").cast("double"))), F.lit(0.0)).alias("hit_rate"),
            F.avg(F.when(done, F.pow(F.col("up_probability") - went_up(), 2))).alias("brier_score"),
        )
        .withColumn("symbol", F.coalesce("symbol", F.lit("ALL")))
    )


def latest_per_symbol(registry: DataFrame) -> DataFrame:
    """Newest target date per symbol with its drivers as a map; partial aggregation, no sort."""
    rest = [c for c in registry.columns if c != "symbol"]
    best = registry.groupBy("symbol").agg(
        F.max_by(F.struct(*rest), F.struct("target_date", "generated_at", "prediction_id")).alias("_p")
    )
    return best.select("symbol", "_p.*").withColumn("drivers", F.from_json("drivers_json", "map<string,double>"))


def drivers_long(latest: DataFrame) -> DataFrame:
    return latest.select("symbol", F.explode("drivers").alias("feature", "weight"))


def listing(registry: DataFrame, n: int = 50, symbol: str | None = None) -> DataFrame:
    """The n newest predictions with a direction label (a top-n report)."""
    return (
        find_predictions(registry, symbol)
        .withColumn("label", F.when(F.col("up_probability") >= 0.5, "UP").otherwise("DOWN"))
        .orderBy(F.desc("target_date"), "prediction_id")
        .limit(n)
    )
