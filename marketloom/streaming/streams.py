"""Streaming forms: bar upsert, dedupe, windowed counts, tick bars, late releases.

All run to completion on what is available and can be restarted from their checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.clean import merge_increment, validate_prices
from marketloom.operators.dedupe import keep_last
from marketloom.plans.macro import MACRO_KEY, macro_daily
from marketloom.schemas import PRICES
from marketloom.sources.tables import DatasetNotFoundError, read_or_empty, read_version, write_partitions, write_version

# Sessions open at 09:15 local time, which is 04:15 on the UTC clock.
OPEN_OFFSET = "4 hours 15 minutes"


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet", files_per_batch: int = 1000) -> DataFrame:
    """File stream over a folder; new files form the next batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def run_batches(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """foreachBatch over everything available. ``handle`` must be idempotent."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keep_partials(folder: str, make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch handler: write ``make(batch)`` as the batch's own partition, replacing it on a replay.

    Partials merge in any order, so what is read does not depend on how the input was cut
    into batches, or on how late a row came. Each is as large as the keys its batch touched.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return handle


def read_partials(spark: SparkSession, folder: str) -> DataFrame:
    """All partials so far, with the number of their batch."""
    return spark.read.parquet(folder)


def upsert_bars(table: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """Batch handler: validate, dedupe, merge past the high-water mark, re-adjust, replace touched symbols."""

    def handle(batch: DataFrame, _: int) -> None:
        fresh = validate_prices(batch, order).select(*PRICES.fieldNames())
        stored = read_or_empty(batch.sparkSession, table, PRICES).select(*PRICES.fieldNames())
        write_partitions(merge_increment(stored, fresh), table)

    return handle


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_first_seen(stream: DataFrame, keys: list[str], folder: str, checkpoint: str) -> None:
    """Append to ``folder`` one row for each key that no earlier batch held, for all time.

    Known keys are keyed state of the stream (nulls are equal), on the disks of the executors
    and in the checkpoint by increments: a batch looks up its own keys and reads no history.
    The file sink lists what each batch wrote, so a replayed batch counts once.
    """
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, ROCKSDB)
    try:
        writer = stream.dropDuplicates(keys).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start(folder).awaitTermination()
    finally:
        conf.set(name, before)


def news_windows(keys: list[str], time: str, hours: int, score: Column) -> Callable[[DataFrame], DataFrame]:
    """Partial counts and score sums over windows (open - hours, open] that end at each daily opening.

    Spark windows are closed on the left, the rule is closed on the right, so times are
    moved back by one microsecond.
    """

    def make(batch: DataFrame) -> DataFrame:
        moved = batch.withColumn("_t", F.col(time) - F.expr("INTERVAL '0.000001' SECOND"))
        span = F.window("_t", f"{hours} hours", "24 hours", OPEN_OFFSET)
        return (
            moved.withColumn("_s", score)
            .groupBy(span.alias("w"), *keys)
            .agg(F.count(F.lit(1)).alias("news_count"), F.sum("_s").alias("score_sum"))
            .select(*keys, F.to_date("w.end").alias("session_date"), "news_count", "score_sum")
        )

    return make


def merge_windows(partials: DataFrame, keys: list[str]) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("news_count", "score_sum")]
    return partials.groupBy(*keys, "session_date").agg(*sums)


def tick_partials(symbol: str, time: str, price: Column, volume: Column, seq: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Partial daily bars: first and last price with their order, high, low and volume."""
    order = F.struct(time, *seq)

    def make(batch: DataFrame) -> DataFrame:
        ticks = batch.select(F.col(symbol).alias("symbol"), F.to_date(time).alias("trade_date"), order.alias("o"), price.alias("p"), volume.alias("v"))
        tick = F.struct("o", "p")
        return ticks.groupBy("symbol", "trade_date").agg(
            F.min(tick).alias("first"), F.max(tick).alias("last"), F.max("p").alias("high"), F.min("p").alias("low"), F.sum("v").alias("volume")
        )

    return make


def merge_ticks(partials: DataFrame) -> DataFrame:
    """Daily bars from the partials of any number of batches."""
    return partials.groupBy("symbol", "trade_date").agg(
        F.min("first")["p"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max("last")["p"].alias("close"), F.sum("volume").alias("volume"),
    )


def late_releases(raw_table: str, daily_table: str, sessions: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch handler: keep the last value per release and rebuild the daily macro table as a new version.

    The raw table is small (one row per release), so it is versioned as a whole.
    """

    def handle(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        incoming = batch.withColumn("_rank", F.lit(1))
        try:
            incoming = read_version(spark, raw_table).withColumn("_rank", F.lit(0)).unionByName(incoming)
        except DatasetNotFoundError:
            pass
        write_version(keep_last(incoming, MACRO_KEY, ["_rank", "value"]).drop("_rank"), raw_table)
        write_version(macro_daily(read_version(spark, raw_table), sessions()), daily_table)

    return handle


