"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

*Weights.* Every run of one or two words of a text falls into a hash bucket. Bucket counts of
the corpus and of the target texts give a gain for each bucket; a document's weight is the
mean gain of its features, looked up in an array of all gains.

*Draw.* Each weight gets Gumbel noise from a hash of the id, so that the highest scores are a
draw without replacement.

*Ranks.* A least-significant-digit radix sort over the composite key (score, id): in each pass
blocks of rows count their digits, prefix sums over (digit, block) give each count its offset,
and a row's new place is that offset plus its place among the equal digits of its block. The
passes are stable, a block holds 2 ** BLOCK_BITS rows at most, and no digit, score or id is
brought into one task.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25
#: Bits of a digit, and of the places that one block holds.
DIGIT_BITS = 11
BLOCK_BITS = 12
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

_LOW = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
_TABLE = bytes(b if b in _WORD_BYTES else 0x20 for b in _LOW)


def word_lists(text: bytes | None, piece: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text (UTF-8), in lists of bounded size."""
    start, step = 0, piece
    while text and start < len(text):
        part = text[start : start + step].translate(_TABLE)
        if start + step < len(text):
            end = part.rfind(b" ")
            if end < 0:  # one word fills the piece
                step *= 2
                continue
            part = part[:end]
        yield part.split()
        start, step = start + len(part) + 1, piece


def feature_buckets(text: bytes | None, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of their one- and two-word features) for each list of words."""
    before = None
    for words in word_lists(text):
        if not words:
            continue
        ones = list(map(crc32, words))
        after = [b" " + w for w in words]
        # the hash of two words goes on from that of the first
        twos = list(map(crc32, after[1:], ones))
        if before is not None:
            twos.append(crc32(after[0], before))
        before = ones[-1]
        yield len(words), np.array(ones + twos, np.int64) % buckets


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows of ``text`` in each bucket; each task sends one count a bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(counted, "bucket int, n long")
    counts = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        counts[bucket] = n
    return counts


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus frequency, with one more in each bucket."""
    n = len(corpus)
    all_s, all_t = int(corpus.sum()) + n, int(target.sum()) + n
    ratios = (((t + 1) * all_s) / ((s + 1) * all_t) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of the Gumbel noise of an id (null: of the empty string)."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row of ``doc_id``, ``text``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = features = total = 0
                for n, found in feature_buckets(text.as_py(), len(gains)):
                    words, features, total = words + n, features + len(found), total + int(gains[found].sum())
                weight = total // features if features else 0
                rows.append((words, features, weight, weight + noise(doc_id, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(scored, "doc_id long, n_words long, n_features long, weight long, score long")


def key_digits(fields: list[tuple[Column, int]], width: int = DIGIT_BITS) -> list[Column]:
    """Digits, the least first, of the low bits of the fields, of which the least comes first."""
    digits = []
    for at in range(0, sum(bits for _, bits in fields), width):
        parts, base = [], 0
        for field, bits in fields:
            lo, hi = max(at, base), min(at + width, base + bits)
            if lo < hi:
                part = F.shiftrightunsigned(field, lo - base).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long"))
                parts.append(F.shiftleft(part, lo - at))
            base += bits
        digits.append(functools.reduce(Column.bitwiseOR, parts))
    return digits


def counting_pass(rows: DataFrame, digit: Column, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Give the rows the places (from 0, gapless) of a stable sort by one digit."""
    rows = rows.withColumns({"digit": digit, "block": F.shiftright("place", block_bits)})
    counts = rows.groupBy("digit", "block").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 ** DIGIT_BITS rows
    starts = counts.groupBy("digit").agg(F.sum("n").alias("n"))
    starts = starts.select("digit", (F.sum("n").over(Window.orderBy("digit")) - F.col("n")).alias("start"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(starts, "digit")
    offsets = offsets.select("digit", "block", (F.col("start") + F.col("before")).alias("offset"))
    within = F.row_number().over(Window.partitionBy("digit", "block").orderBy("place"))
    placed = rows.withColumn("within", within).join(offsets, ["digit", "block"])
    return placed.withColumn("place", F.col("offset") + F.col("within") - 1).drop("digit", "block", "offset", "within")


def radix_sorted(rows: DataFrame, fields: list[tuple[Column, int]], width: int = DIGIT_BITS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows with ``place``: from 0, gapless, in the order of the unsigned fields, the last field first.

    ``rows`` holds any distinct numbers as ``place``. Equal keys keep their order. Fields
    without bits leave the order as it is.
    """
    for digit in key_digits(fields, width) or [F.lit(0).cast("long")]:
        rows = cut_lineage(counting_pass(rows, digit, block_bits))
    return rows


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row of ``docs``.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest
    scores are drawn, ties to the smaller ``doc_id`` (null ids last); their ranks go from 1,
    the others' are null. Null texts count as empty, and an empty text has weight 0. Repeated
    rows score alike and are drawn one by one. An empty target leaves every gain as small
    counts make it. Other columns are not read. Empty in, empty out.
    """
    corpus, wanted = bucket_counts(docs, buckets), bucket_counts(target, buckets)
    rows = weighed(docs, bucket_gains(corpus, wanted), seed)
    rows = cut_lineage(rows.withColumn("place", F.monotonically_increasing_id()))
    pool = rows.where(F.col("n_words") >= least_words)
    ends = pool.agg(
        F.count("*"), F.count("doc_id"), F.min("doc_id"), F.max("doc_id"), F.coalesce(F.min("score"), F.lit(0)), F.coalesce(F.max("score"), F.lit(0))
    ).first()
    total, ids, first, last, lo, hi = ends
    fields = [(F.coalesce("doc_id", F.lit(0)), _varying(first, last)), (F.col("doc_id").isNull().cast("long"), int(ids < total))]
    if ids and first < 0 <= last:  # the sign bit decides, the other way round
        fields[0] = (F.coalesce("doc_id", F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))), 64)
    fields.append((F.lit(hi) - F.col("score"), (hi - lo).bit_length()))
    ranked = radix_sorted(pool, fields)
    rank = F.when(F.col("place") < percent * total // 100, F.col("place") + 1)
    others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", rank).unionByName(others).drop("place")


def _varying(first: int | None, last: int | None) -> int:
    """Low bits in which numbers of one sign between the two can differ."""
    return 0 if first is None else ((first ^ last) & (1 << 64) - 1).bit_length()


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_resampling": op11_resampling}
CHECKS: dict[str, str] = {}
