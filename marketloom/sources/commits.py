"""Immutable raw landing: batches of payloads that count once their manifest is committed.

A batch is two folders under a root: ``data/<batch>`` holds the payloads, each with the hash
of its content, and ``manifest/<batch>`` one row per source and day: payloads, bytes and an order-free
digest of the hashes. The manifest is written last, so its ``_SUCCESS`` file is the commit. A
writer that fails half-way leaves a folder that no reader lists; the retry writes over it. A
committed batch is never written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.functions.text import content_hash
from marketloom.sources.tables import committed

DATA = "batch string, source string, ingest_date date, symbol string, payload string, content_key string"
MANIFEST = "batch string, source string, ingest_date date, payloads bigint, bytes bigint, digest decimal(38,0)"


class ContentMismatchError(RuntimeError):
    """What was stored is not what its manifest says."""


def content_key(source="source", payload="payload"):
    """The hash of a payload under its source; a null payload has a hash of its own."""
    return content_hash(F.coalesce(F.col(source), F.lit("")), F.coalesce(F.col(payload), F.lit("\x00")))


def _summary(rows: DataFrame) -> DataFrame:
    """Payloads, bytes and digest of the stored keys per batch, source and day: one map-side aggregation."""
    return rows.groupBy("batch", "source", "ingest_date").agg(
        F.count(F.lit(1)).alias("payloads"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0)).cast("bigint").alias("bytes"),
        F.sum(F.xxhash64("content_key").cast("decimal(38,0)")).cast("decimal(38,0)").alias("digest"),
    )


def land(payloads: DataFrame, root: str, batch: str) -> bool:
    """Store the payloads (source, ingest_date, symbol, payload) as one batch; False where it is committed already.

    Null sources and days make their own group of the manifest. The manifest is computed from
    what was stored, so rows that a source draws anew on a retry cannot differ from it.
    """
    spark = payloads.sparkSession
    if batch in committed(spark, f"{root}/manifest"):
        return False
    rows = payloads.select(
        F.lit(batch).alias("batch"), "source", F.col("ingest_date").cast("date").alias("ingest_date"), "symbol", "payload", content_key().alias("content_key")
    )
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/data/{batch}")
    stored = spark.read.schema(DATA).parquet(f"{root}/data/{batch}")
    _summary(stored).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{batch}")
    return True


def _read(spark: SparkSession, root: str, part: str, schema: str) -> DataFrame:
    batches = committed(spark, f"{root}/manifest")
    return spark.read.schema(schema).parquet(*[f"{root}/{part}/{b}" for b in batches]) if batches else spark.createDataFrame([], schema)


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Payloads of the committed batches."""
    return _read(spark, root, "data", DATA)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return _read(spark, root, "manifest", MANIFEST)


def verify(spark: SparkSession, root: str) -> DataFrame:
    """The manifest's groups with ``intact``: payloads, bytes and hashes computed anew are those of the manifest."""
    again = _summary(landed(spark, root).withColumn("content_key", content_key()))
    old, new = manifest(spark, root).alias("m"), again.alias("n")
    keys = ("batch", "source", "ingest_date")
    on = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in keys]
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ("payloads", "bytes", "digest")]
    return old.join(new, on, "full").select(
        *[F.coalesce(f"m.{c}", f"n.{c}").alias(c) for c in keys], F.coalesce("m.payloads", F.lit(0)).alias("payloads"),
        F.coalesce("m.bytes", F.lit(0)).alias("bytes"), (same[0] & same[1] & same[2]).alias("intact"),
    )


def read_verified(spark: SparkSession, root: str) -> DataFrame:
    """Committed payloads, after the check of ``verify``; a damaged batch raises ContentMismatchError."""
    bad = [r.batch for r in verify(spark, root).where("NOT intact").select("batch").distinct().limit(10).collect()]
    if bad:
        raise ContentMismatchError(", ".join(sorted(bad)))
    return landed(spark, root)
