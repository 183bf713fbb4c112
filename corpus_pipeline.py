"""The corpus pipeline: quality, near copies, benchmark passages, packing.

Each stage reads all rows that the one before it kept. All but the last return the columns
of ``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.decontamination import find_items
from marketloom.llm.packing import pack_documents
from marketloom.llm.quality import THRESHOLD, fit_quality, held_out, score_quality
from marketloom.llm.simhash import near_copy_groups
from marketloom.session import shared_folder


def _unused(docs: DataFrame, name: str) -> str:
    """The name, with underscores before it while a column bears it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; texts without words count as usual."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels.where(~held_out("doc_id", 4, 2)))
    score = _unused(docs, "score")
    return score_quality(docs, model, tuple(docs.columns), score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least ``doc_id``."""
    kept = near_copy_groups(docs).where("keeper").select(
        F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), (F.col("copies") > 1).alias("kept_again")
    )
    own = _unused(docs, "text_hash")
    clash = {c: _unused(docs, c) for c in kept.columns}
    kept = kept.withColumnsRenamed(clash)
    same = F.col("doc_id").eqNullSafe(F.col(clash["kept_id"])) & (F.col(own) == F.col(clash["kept_hash"]))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).join(kept, same)
    again = F.col(clash["kept_again"])
    # only rows that occur more than once are dealt out again to leave one of them
    return rows.where(~again).select(*docs.columns).unionAll(rows.where(again).dropDuplicates(["doc_id", own]).select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    matches = _unused(docs, "matches")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tuple(docs.columns), name=matches)
    return found.where(F.size(matches) == 0).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("packing", packing)]

#: SQL can state neither compressed sizes nor fingerprints nor token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
