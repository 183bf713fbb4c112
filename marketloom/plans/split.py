"""Chronological splits and walk-forward folds as tables (no look-ahead, no index arrays)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.windows import per_symbol
from marketloom.session import cut_lineage

MIN_ROWS = 20


def numbered(df: DataFrame, needed: list[str]) -> DataFrame:
    """Rows without nulls in ``needed``, numbered from 0 per symbol, with the symbol's row count."""
    clean = df.na.drop(subset=needed)
    return clean.withColumns(
        {
            "row_no": F.row_number().over(per_symbol()) - 1,
            "n_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol")),
        }
    )


def chronological_split(
    df: DataFrame, features: list[str], target: str = "target_next_day_dir", ratio: float = 0.8
) -> DataFrame:
    """Adds role train/test: the first floor(n * ratio) clean rows of each symbol train."""
    if not 0.1 <= ratio <= 0.95:
        raise ValueError("ratio must lie in [0.1, 0.95]")
    rows = numbered(df, [*features, target]).filter(F.col("n_rows") >= MIN_ROWS)
    cut = F.floor(F.col("n_rows") * ratio)
    return rows.withColumn("role", F.when(F.col("row_no") < cut, "train").otherwise("test"))


def split_by_date(df: DataFrame, features: list[str], target: str, ratio: float = 0.8) -> DataFrame:
    """Panel split on one global date, so that no symbol trains on days another is tested on.

    The cut date is the one below which the given share of distinct sessions lies. The
    clean rows are written once, since the cut and both roles read them.
    """
    clean = cut_lineage(df.na.drop(subset=[*features, target]))
    days = clean.select("trade_date").distinct()
    ranked = days.withColumn("_r", F.row_number().over(Window.orderBy("trade_date")))  # one row per day
    cut = ranked.filter(F.col("_r") > F.floor(days.agg(F.count(F.lit(1))).scalar() * ratio)).agg(F.min("trade_date"))
    return clean.withColumn("role", F.when(F.col("trade_date") < cut.scalar(), "train").otherwise("test"))


def walk_forward_folds(
    counts: DataFrame, train: int = 500, test: int = 60, step: int = 60, embargo: int = 5,
    mode: str = "expanding", min_test: int = 15,
) -> DataFrame:
    """Fold bounds per symbol from its row count; the last fold may be short.

    Row ranges are half open: [train_start, train_end), [test_start, test_end).
    """
    if train <= 0 or test <= 0 or step <= 0 or embargo < 0 or mode not in ("expanding", "rolling"):
        raise ValueError("invalid walk-forward parameters")
    n, k = F.col("n_rows"), F.col("fold")
    most = F.floor((n - train - embargo) / step)
    folds = counts.filter(n >= train + embargo + min_test).select(
        "symbol", "n_rows", F.explode(F.sequence(F.lit(0), F.greatest(most, F.lit(0)).cast("int"))).alias("fold")
    )
    end = k * step + train
    begin = end + embargo
    closed = F.least(begin + test, n)
    earlier_reached_end = (k > 0) & (begin - step + test >= n)
    return folds.filter((begin < n) & (closed - begin >= min_test) & ~earlier_reached_end).select(
        "symbol", "fold",
        (F.lit(0) if mode == "expanding" else k * step).cast("bigint").alias("train_start"),
        end.cast("bigint").alias("train_end"), begin.cast("bigint").alias("test_start"), closed.cast("bigint").alias("test_end"),
    )


def expanding_oof_folds(counts: DataFrame, splits: int = 4, min_train_ratio: float = 0.4) -> DataFrame:
    """Equal validation blocks after a first training part; the last takes the remainder."""
    n = F.col("n_rows")
    base = counts.filter(n >= MIN_ROWS).withColumn(
        "_first", F.greatest(F.lit(10), F.floor(n * min_train_ratio))
    ).withColumn("_pool", n - F.col("_first"))
    base = base.withColumn(
        "_k", F.when(F.col("_pool") < splits, F.greatest(F.lit(1), F.col("_pool"))).otherwise(F.lit(splits))
    ).withColumn("_size", F.floor(F.col("_pool") / F.col("_k")))
    k = F.col("fold")
    start = F.col("_first") + k * F.col("_size")
    end = F.when(k == F.col("_k") - 1, n).otherwise(start + F.col("_size"))
    folds = base.withColumn("fold", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
    return folds.select(
        "symbol", "fold", F.lit(0).cast("bigint").alias("train_start"), start.cast("bigint").alias("train_end"),
        start.cast("bigint").alias("test_start"), end.cast("bigint").alias("test_end"),
    ).filter("train_end > train_start AND test_end > test_start")


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_rows"))


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with (fold, role); an equi-join on symbol with the row range as residual."""
    i = F.col("row_no")

    def inside(a: str, b: str) -> Column:
        return (i >= F.col(a)) & (i < F.col(b))

    bounds = ["train_start", "train_end", "test_start", "test_end"]
    train, held = inside(*bounds[:2]), inside(*bounds[2:])
    return (
        rows.join(folds, "symbol")
        .filter(train | held)
        .withColumn("role", F.when(train, "train").otherwise("test"))
        .drop(*bounds)
    )
