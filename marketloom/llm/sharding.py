"""Proportional stratified interleaving: shards of equal row counts that all match the mixture.

Rows are shuffled by a seeded hash and ranked within their source; sorted by the fractional
rank (rank - 1/2) / rows of the source, every stretch of the order holds the sources in
proportion. Cut at equal counts, each stretch is a shard. Ranks are exact and no group is
ordered in one task: rows fall into cells by the leading bits of the hash (or of the
fraction), cells are counted, and a row's rank is the rows of the cells before its own
plus its place within the cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

SHARDS = 40
SEED = 7
#: Rows that one cell holds on average; the number of cells follows the table.
CELL_ROWS = 1_000


def _placed(rows: DataFrame, group: list[str], cell: str, order: list[str], name: str) -> DataFrame:
    """Add the place (from 0) of each row within its group, ordered by cell and then ``order``."""
    counts = rows.groupBy(*group, cell).agg(F.count("*").alias("held"))
    before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, cell, F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order))
    placed = rows.withColumn("within", within).join(counts, [*group, cell])
    return placed.withColumn(name, F.col("before") + F.col("within") - 1).drop("before", "within")


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot (from 0, gapless) of each row.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 16. Null sources form a source
    of their own; null ids and repeated rows get slots like any other (equal rows: in any
    order). Fewer rows than shards leave shards empty. Other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id").alias("h"),
        )
    )
    strata = rows.groupBy("stratum").agg(F.count("*").alias("stratum_rows"))
    total = strata.agg(F.coalesce(F.sum("stratum_rows"), F.lit(0))).first()[0]
    bits = max(1, (total // cell_rows).bit_length())
    ties = ["h", "doc_id", "size", "text_crc32"]
    ranked = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
    # the hash in unsigned order, as the cells are
    ranked = _placed(ranked, ["stratum"], "cell", [F.shiftrightunsigned("h", 1), *ties], "rank").join(strata, "stratum")
    part = (F.col("rank") + 0.5) / F.col("stratum_rows")
    ranked = ranked.withColumn("part", part).withColumn("cell", F.floor(part * (1 << bits)))
    placed = _placed(ranked.withColumn("all", F.lit(0)), ["all"], "cell", ["part", "stratum", *ties], "place")
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - start).alias("slot")
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = interleave(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op9_sharding": op9_sharding}
CHECKS: dict[str, str] = {}
