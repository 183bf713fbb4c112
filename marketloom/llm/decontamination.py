"""Benchmark items inside documents: size-partitioned MinHash containment search.

Containment of an item in a document is the share of the item's distinct five-word
shingles that the document holds. Shingles are ordered by a hash, as in MinHash. Items are
partitioned by their number of shingles; an item's sketch is its k least hashes, and k
follows its partition: a document that holds a share t of at most u shingles misses at
most (1 - t) u of them, so with k = floor((1 - t) u) + 1 it must hold one of the sketch.
Of a document only hashes up to the partitions' largest sketch hash can match; the others
are passed over. No size of document lowers the chance of a match, as it would when
signatures of long documents were compared with those of short items.

Candidates are verified by the exact containment of the shingles themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.caches import remembered

WIDTH = 5
SIMILARITY = 0.8
#: Items that one pass over the documents searches for; more items take more passes.
BLOCK_ITEMS = 50_000
#: Words one Python worker remembers the hashes of.
CACHE_WORDS = 150_000
WORD = re.compile(r"\w+")

_FACTOR = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 1)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


def word_hashes() -> WordHashes:
    return remembered(("words",), WordHashes)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words from the words' hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(_FACTOR) + hashes[k : k + n]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def shingles(words: list[str], width: int) -> set[str]:
    return {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


@dataclass
class Sketches:
    """Least hashes of the items, by shingle width; items' shingles for the exact check."""

    hashes: dict[int, np.ndarray]  # width -> sorted sketch hashes
    owners: dict[int, np.ndarray]  # the item of each, by place
    texts: list[tuple[int, int, frozenset[str]]]  # item id, width, shingles
    similarity: float


def sketch_items(items: list[tuple[int, str]], similarity: float = SIMILARITY, width: int = WIDTH) -> Sketches:
    """Sketches of a block of items; items without words are left out (nothing can hold them).

    An item of fewer words than ``width`` is one shingle of all its words.
    """
    texts, found = [], {}
    for item_id, text in items:
        words = words_of(text)
        if not words:
            continue
        w = min(width, len(words))
        own = shingles(words, w)
        h = np.unique(shingle_hashes(np.array([word_hashes()[x] for x in words], np.uint64), w))
        upper = 1 << (len(own) - 1).bit_length()  # the partition's largest number of shingles
        k = min(len(h), math.floor((1 - similarity) * upper + 1e-9) + 1)
        for value in h[:k].tolist():
            found.setdefault(w, []).append((value, len(texts)))
        texts.append((item_id, w, frozenset(own)))
    hashes, owners = {}, {}
    for w, pairs in found.items():
        pairs.sort()
        hashes[w] = np.array([p[0] for p in pairs], np.uint64)
        owners[w] = np.array([p[1] for p in pairs], np.int64)
    return Sketches(hashes, owners, texts, similarity)


def matches(text: str | None, sketches: Sketches) -> list[tuple[int, float]]:
    """(item id, containment) of the items that the text holds to the wanted share."""
    words = words_of(text)
    if not words:
        return []
    hashes = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    candidates: set[int] = set()
    for w, sketch in sketches.hashes.items():
        h = shingle_hashes(hashes, w)
        h = h[h <= sketch[-1]]
        at = np.searchsorted(sketch, h)
        for value in np.unique(h[sketch[at] == h]).tolist():
            lo, hi = np.searchsorted(sketch, value), np.searchsorted(sketch, np.uint64(value), side="right")
            candidates.update(sketches.owners[w][lo:hi].tolist())
    if not candidates:
        return []
    held: dict[int, set[str]] = {}
    found = []
    for k in candidates:
        item_id, w, own = sketches.texts[k]
        if w not in held:
            held[w] = shingles(words, w)
        share = len(own & held[w]) / len(own)
        if share >= sketches.similarity:
            found.append((item_id, share))
    return sorted(found, key=lambda m: (m[0] is None, m[0], m[1]))


def find_items(
    docs: DataFrame, items: DataFrame, keep: tuple[str, ...], similarity: float = SIMILARITY, block_items: int = BLOCK_ITEMS, name: str = "matches"
) -> DataFrame:
    """The columns ``keep`` and, as ``name``, the matches: an array of (item_id, containment), of each row.

    Words are runs of letters, digits and underscores, lower-cased. Items of the same text
    are searched once and all reported. The items (``item_id``, ``text``) are read in blocks
    of ``block_items``, each sent to the tasks as one table of bounded size. Null and empty
    documents, and items without words, match nothing. Repeated rows stay; an item's null id
    is reported as null; other columns are not read. Empty in, empty out.
    """
    from pyspark.sql.types import StructField, StructType

    read = [*keep] if "text" in keep else [*keep, "text"]
    at = read.index("text")
    kind = StructType.fromDDL("m array<struct<item_id: bigint, containment: double>>")[0].dataType
    out = StructType([*(docs.schema[c] for c in read), StructField(name, kind)])
    schema = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))

    spark = docs.sparkSession
    blocks: list = []
    block: list[tuple[int, str]] = []
    for row in items.select("item_id", "text").toLocalIterator():
        block.append((row.item_id, row.text))
        if len(block) == block_items:
            blocks.append(spark.sparkContext.broadcast(sketch_items(block, similarity)))
            block = []
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(sketch_items(block, similarity)))

    def pass_over(block, before: int):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sketches = block.value
            for batch in batches:
                found = [[{"item_id": i, "containment": c} for i, c in matches(t.as_py(), sketches)] for t in batch.column(at)]
                if before:
                    found = [a + b for a, b in zip(batch.column(len(read)).to_pylist(), found)]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(read)], pa.array(found, schema)], names=[*read, name])

        return search

    rows = docs.select(*read)
    for before, one in enumerate(blocks):
        rows = rows.mapInArrow(pass_over(one, before), out)
    return rows.select(*keep, name)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), ("doc_id",))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("leaked"),
        F.col("matches.item_id").alias("item_ids"),
        F.round(F.array_max("matches.containment"), 6).alias("containment"),
    )


QUERIES = {"op3_decontamination": op3_decontamination}
CHECKS = {
    "op3_decontamination": r"""
WITH doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark
), widths AS (
  SELECT DISTINCT least(5, len(w)) AS width FROM item_words WHERE len(w) > 0
), item_shingles AS (
  SELECT DISTINCT item_id, least(5, len(w)) AS width, unnest([array_to_string(w[i : i + least(5, len(w)) - 1], ' ')
    FOR i IN range(1, len(w) - least(5, len(w)) + 2)]) AS s FROM item_words WHERE len(w) > 0
), sizes AS (
  SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id
), doc_shingles AS (
  SELECT DISTINCT r, width, unnest([array_to_string(w[i : i + width - 1], ' ') FOR i IN range(1, len(w) - width + 2)]) AS s
  FROM doc_words, widths WHERE len(w) >= width
), shared AS (
  SELECT r, item_id, count(*) AS k FROM doc_shingles JOIN item_shingles USING (width, s) GROUP BY r, item_id
), found AS (
  SELECT r, item_id, k / n AS c FROM shared JOIN sizes USING (item_id) WHERE k / n >= 0.8
), listed AS (
  SELECT r, list(item_id ORDER BY item_id) AS item_ids, max(c) AS c FROM found GROUP BY r
)
SELECT doc_id, c IS NOT NULL AS leaked, coalesce(item_ids, []) AS item_ids, round(c, 6) AS containment
FROM doc_words LEFT JOIN listed USING (r)
""",
}
