"""Layered tables: readers, writers, views, parameterised SQL, inventory and logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.schemas import UNIVERSE


class DatasetNotFoundError(FileNotFoundError):
    """The requested dataset does not exist."""


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; the projection reaches the reader. A missing path raises DatasetNotFoundError."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        df = reader.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise DatasetNotFoundError(path) from exc
        raise
    return df.select(*columns) if columns else df


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return read_table(spark, path, schema=schema)
    except DatasetNotFoundError:
        return spark.createDataFrame([], schema)


def write_partitions(df: DataFrame, path: str, by: str = "symbol") -> None:
    """Replace only the partitions present in ``df``; the rest of the table stays.

    Files are staged and moved at job commit, so the old partitions survive a failed
    job. Rows are clustered by partition first, with AQE splitting a hot one.
    """
    (
        df.hint("rebalance", by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(by)
        .parquet(path)
    )


def append_rows(df: DataFrame, path: str, *by: str) -> None:
    writer = df.write.mode("append").option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def committed(spark: SparkSession, root: str) -> list[str]:
    """Names of the folders under ``root`` whose job committed (it leaves a _SUCCESS file)."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    folders = [status.getPath() for status in fs.listStatus(base)]
    return sorted(f.getName() for f in folders if fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))


def _complete_versions(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n[1:]) for n in committed(spark, root) if n.startswith("v") and n[1:].isdigit())


def write_version(df: DataFrame, root: str) -> str:
    """Write a whole new version beside the old ones; readers switch when the job commits."""
    path = f"{root}/v{max(_complete_versions(df.sparkSession, root), default=0) + 1:06d}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The latest committed version."""
    versions = _complete_versions(spark, root)
    if not versions:
        raise DatasetNotFoundError(root)
    return spark.read.parquet(f"{root}/v{versions[-1]:06d}")


#: Layers that are written as whole versions.
VERSIONED = ("macro", "predictions")


@dataclass(frozen=True)
class Layout:
    """One partitioned table per layer under a common root."""

    root: str

    @property
    def raw(self) -> str:
        return f"{self.root}/raw"

    @property
    def prices(self) -> str:
        return f"{self.root}/processed/prices"

    @property
    def news(self) -> str:
        return f"{self.root}/processed/news"

    @property
    def macro(self) -> str:
        return f"{self.root}/processed/macro"

    @property
    def features(self) -> str:
        return f"{self.root}/features/combined"

    @property
    def predictions(self) -> str:
        return f"{self.root}/predictions"

    @property
    def models(self) -> str:
        return f"{self.root}/models"

    @property
    def runs(self) -> str:
        return f"{self.root}/reports/runs"

    @property
    def ledger(self) -> str:
        return f"{self.root}/reports/ledger"

    @property
    def rejects(self) -> str:
        return f"{self.root}/rejects"

    def views(self) -> dict[str, str]:
        return {
            "prices": self.prices, "news_signals": self.news, "macro": self.macro,
            "features": self.features, "predictions": self.predictions,
        }


def register_view(spark: SparkSession, name: str, glob: str) -> None:
    read_table(spark, glob).createOrReplaceTempView(name)


def register_views(spark: SparkSession, layout: Layout) -> list[str]:
    """Views for the layers that exist; of a versioned layer, its latest committed version."""
    made = []
    for name, path in layout.views().items():
        try:
            table = read_version(spark, path) if name in VERSIONED else read_table(spark, path)
        except DatasetNotFoundError:
            continue
        table.createOrReplaceTempView(name)
        made.append(name)
    return made


REJECTS = "step string, reason string, row_key string, record string"


def keep_rejects(rejected: DataFrame, root: str, step: str, key: str) -> None:
    """Add rows that a step refused (with their ``reason``) to the side table, each once.

    A row is kept whole as JSON, so tables of any shape share the side table. Rows of an
    earlier run stay; a rerun that refuses the same rows adds nothing.
    """
    spark = rejected.sparkSession
    record = F.to_json(F.struct(*[c for c in rejected.columns if c != "reason"]))
    rows = rejected.select(F.lit(step).alias("step"), "reason", F.col(key).cast("string").alias("row_key"), record.alias("record"))
    try:
        rows = read_version(spark, root).unionByName(rows)
    except DatasetNotFoundError:
        pass
    write_version(rows.distinct(), root)


def reject_counts(spark: SparkSession, root: str) -> DataFrame:
    """Refused rows per step and reason; empty where nothing was ever refused."""
    try:
        rows = read_version(spark, root)
    except DatasetNotFoundError:
        rows = spark.createDataFrame([], REJECTS)
    return rows.groupBy("step", "reason").agg(F.count(F.lit(1)).alias("rejected"))


def sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """Parameterised SQL over registered views; values are bound, never pasted."""
    return spark.sql(text, args=params)


def universe_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Configured instruments; symbols must be alphanumeric, upper case is enforced."""
    clean = []
    for row in rows:
        symbol = str(row["symbol"]).strip().upper()
        if not symbol.isalnum():
            raise ValueError(f"symbol must be alphanumeric: {row['symbol']}")
        clean.append({"name": None, "sector": None, "feed_ticker": None, "enabled": True, **row, "symbol": symbol})
    return spark.createDataFrame([[r[c] for c in UNIVERSE.fieldNames()] for r in clean], UNIVERSE)


def find_instrument(universe: DataFrame, symbol: str) -> DataFrame:
    return universe.filter(F.col("symbol") == symbol.strip().upper())


def enabled_instruments(universe: DataFrame) -> DataFrame:
    return universe.filter("enabled")


RUNS = (
    "run_id string, started_at timestamp, finished_at timestamp, "
    "tasks array<struct<name:string,status:string,rows:bigint,message:string>>"
)


def log_run(spark: SparkSession, path: str, run: list) -> None:
    spark.createDataFrame(run, RUNS).coalesce(1).write.mode("append").json(path)


def recent_runs(runs: DataFrame, n: int = 5) -> DataFrame:
    """Last n runs with the counts of tasks that ended well, in them or in the run that they go on with."""
    return (
        runs.select(
            "run_id", "started_at", F.size("tasks").alias("total_tasks"),
            F.size(F.filter("tasks", lambda t: t["status"].isin("SUCCESS", "REUSED"))).alias("succeeded"),
        )
        .orderBy(F.desc("started_at"), F.desc("run_id"))
        .limit(n)
    )


def inventory(datasets: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows, date span and distinct keys of each dataset: {name: (table, date column, key column)}."""
    out = None
    for name, (df, day, key) in datasets.items():
        part = df.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.min(F.to_date(F.col(day))).alias("first_date"),
            F.max(F.to_date(F.col(day))).alias("last_date"),
            F.countDistinct(key).alias("distinct_keys"),
        ).select(F.lit(name).alias("dataset"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def manifest(rows: DataFrame, path: str) -> None:
    """Per-symbol results of a run as JSON."""
    rows.coalesce(1).write.mode("overwrite").json(path)
