"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marketloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans rely on (UTC, AQE with skew handling)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


class NoSharedFolderError(RuntimeError):
    """Intermediate tables need a folder that all executors see."""


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a private one, removed when Python
    ends; on a cluster an executor could not see it, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise NoSharedFolderError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-ckpt-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared folder and read it back.

    Used where one result feeds several jobs (splits, folds, evaluation). A lost
    executor then costs a re-read, and each job reads only the columns it needs.
    The table lasts as long as the application may read it; ``drop_cut_tables`` removes all.
    """
    path = f"{_cut_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _cut_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def drop_cut_tables(spark: SparkSession) -> bool:
    """Remove what ``cut_lineage`` wrote in this application, once its results are written."""
    jvm, folder = spark.sparkContext._jvm, _cut_folder(spark)
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by key for CPU-bound work per group.

    The count is that of any other shuffle, but stated, so AQE does not merge
    partitions that are small in bytes yet long in compute.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
