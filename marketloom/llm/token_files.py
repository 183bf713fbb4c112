"""Token-id files compressed by a Re-Pair grammar per shard.

Documents are dealt by ranges of ``doc_id`` and encoded; a task cuts its documents into
shards of about ``shard_ids`` ids. Each shard has a grammar of its own: again and again
the most frequent pairs of neighbouring symbols become nonterminals, until no pair occurs
``least_count`` times. A round replaces up to ``pairs_per_round`` pairs at once, counted exactly over the
whole shard, from left to right without overlap. No pair reaches across the end of a document, so each document is
a whole number of symbols; with the expansion length of every symbol, a document is found
by summing lengths and decoded without its neighbours.

A file set is a Parquet folder, one row per shard: ``part`` and ``seq`` (the shards' order),
``doc_ids`` and ``doc_tokens`` in order, ``rules`` (little-endian unsigned 32-bit triples of
left symbol, right symbol, expansion length; rule i is symbol ``first_rule + i``) and
``symbols`` (little-endian unsigned 16-bit, 32-bit where there are more symbols).
"""

from __future__ import annotations

import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.tokens import END_ID, chunk_ids, encode_text
from marketloom.session import shared_folder

SHARD_IDS = 4_000_000
PAIRS_PER_ROUND = 8192
LEAST_COUNT = 8

SHARDS = (
    "part long, seq long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, "
    "first_rule long, rules binary, symbols binary"
)


def repair(
    ids: np.ndarray,
    first_rule: int,
    end_id: int = END_ID,
    rounds: int | None = None,
    pairs_per_round: int = PAIRS_PER_ROUND,
    least_count: int = LEAST_COUNT,
) -> tuple[np.ndarray, np.ndarray]:
    """(rules as rows of left, right, length; symbols) of a Re-Pair grammar for the ids.

    ``rounds`` is for tests: by default replacement goes on while a pair is frequent enough.

    A pair that is too rare stays so, since every pair that a replacement makes holds its new symbol.
    A round therefore counts only pairs with symbols of the last one and those that were frequent in it.
    """
    used = np.zeros(first_rule, bool)
    used[ids] = True
    names = np.flatnonzero(used).astype(np.uint32)
    # symbols are numbered without gaps, in the order of their ids, so that a pair fits 32 bits for longer
    seq = (np.cumsum(used, dtype=np.uint32) - np.uint32(1))[ids]
    closes = names == end_id
    length = np.ones(len(names), np.uint32)
    rules = [np.zeros((0, 3), np.uint32)]
    live = np.flatnonzero(~closes[seq[:-1]])  # no pair starts with the end of a document
    for _ in itertools.count() if rounds is None else range(rounds):
        if not len(live):
            break
        kind, half = (np.uint32, 16) if len(length) <= 1 << 16 else (np.uint64, 32)
        key = (seq[live].astype(kind, copy=False) << kind(half)) | seq[live + 1]
        ordered = np.sort(key)
        starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
        counts = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(counts >= least_count)
        if not len(often):
            break
        found = ordered[starts[often]]
        rank = _places(key, found)
        near = np.flatnonzero(rank >= 0)
        live, rank = live[near], rank[near]
        del ordered, key, near
        at = live
        if len(often) > pairs_per_round:
            chosen = np.sort(np.lexsort((found, -counts[often]))[:pairs_per_round])
            number = np.full(len(found), -1)
            number[chosen] = np.arange(len(chosen))
            found, rank = found[chosen], number[rank]
            hit = rank >= 0
            at, rank = at[hit], rank[hit]
        # of overlapping occurrences, every second one from the left
        fresh = np.concatenate(([True], np.diff(at) != 1))
        run_start = at[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        take = (at - run_start) % 2 == 0
        at, rank = at[take], rank[take]
        seq[at] = (len(length) + rank).astype(np.uint32)
        changed = np.zeros(len(seq), bool)
        changed[live], changed[at], changed[np.maximum(at, 1) - 1] = True, True, True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, changed = seq[stay], changed[stay]
        left, right = ((found >> kind(half)).astype(np.int64), (found & kind((1 << half) - 1)).astype(np.int64))
        total = length[left] + length[right]
        rules.append(np.stack((left, right, total), axis=1).astype(np.uint32))
        length, closes = np.concatenate((length, total)), np.concatenate((closes, closes[right]))
        live = np.flatnonzero(changed[:-1])
        live = live[~closes[seq[live]]]
    names = np.concatenate((names, np.arange(first_rule, first_rule + len(length) - len(names), dtype=np.uint32)))
    rules = np.concatenate(rules)
    rules[:, :2] = names[rules[:, :2]]
    return rules, names[seq]


def _places(keys: np.ndarray, among: np.ndarray, bits: int = 20) -> np.ndarray:
    """The place of each key in the ascending ``among``, -1 where it is not there."""
    kind = keys.dtype.type
    slot = lambda x: (x * kind(0x9E3779B1 if kind is np.uint32 else 0x9E3779B97F4A7C15)) >> kind(8 * x.itemsize - bits)
    table = np.full(1 << bits, -1, np.int32)
    table[slot(among)] = np.arange(len(among))
    places = table[slot(keys)]
    # those of one slot are told apart by search
    other = np.flatnonzero((places >= 0) & (among[places] != keys))
    found = np.minimum(np.searchsorted(among, keys[other]), len(among) - 1)
    places[other] = np.where(among[found] == keys[other], found, -1)
    return places


def expansions(rules: np.ndarray, first_rule: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of every symbol one after the other, start and length of each symbol's ids)."""
    texts: list[np.ndarray] = []
    one = np.arange(first_rule, dtype=np.uint32)
    of = lambda s: one[s : s + 1] if s < first_rule else texts[s - first_rule]
    for left, right, _ in rules.tolist():
        texts.append(np.concatenate((of(left), of(right))))
    lengths = np.concatenate((np.ones(first_rule, np.int64), rules[:, 2].astype(np.int64)))
    return np.concatenate((one, *texts)), np.cumsum(lengths) - lengths, lengths


def expand(symbols: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids that a row of symbols stands for."""
    flat, start, lengths = tables
    n = lengths[symbols]
    ends = np.cumsum(n)
    if not len(ends):
        return np.zeros(0, np.uint32)
    return flat[np.repeat(start[symbols] - (ends - n), n) + np.arange(ends[-1])]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, shard_ids: int = SHARD_IDS, **grammar) -> None:
    """Encode ``doc_id``, ``text`` and write the files, in ascending order of ``doc_id``.

    A null or empty text is its end id alone; a null ``doc_id`` comes first. Rows of one
    ``doc_id`` follow the order of their texts. Other columns are not read. An empty table
    gives an empty file set.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, part = chunk_ids(tokenizer), TaskContext.get().partitionId()
        first_rule = cache.tokenizer.get_vocab_size()

        def shard(seq: int) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(texts), "<u4")
            rules, symbols = repair(ids, first_rule, **grammar)
            kind = "<u2" if first_rule + len(rules) <= 1 << 16 else "<u4"
            row = [part, seq, doc_ids, [len(t) // 4 for t in texts], len(ids), first_rule, rules.astype("<u4").tobytes(), symbols.astype(kind).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

        doc_ids, texts, held, seq = [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                texts.append(encode_text(cache, text.as_py()))
                held += len(texts[-1]) // 4
                if held >= shard_ids:
                    yield shard(seq)
                    doc_ids, texts, held, seq = [], [], 0, seq + 1
        if texts:
            yield shard(seq)

    names = ["part", "seq", "doc_ids", "doc_tokens", "n_tokens", "first_rule", "rules", "symbols"]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(shards, SHARDS).write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Decode every document: doc_id, start (ids before it), n_tokens, ids_crc32."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rules, symbols = grammar_of(row)
                ids = expand(symbols, expansions(rules, row["first_rule"])).astype("<u4").tobytes()
                ends = np.cumsum(row["doc_tokens"])
                starts = ends - row["doc_tokens"]
                crc = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int64()),
                        pa.array([row["seq"]] * n, pa.int64()),
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(row["doc_tokens"], pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "seq", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(SHARDS).parquet(folder)
    rows = files.select("part", "seq", "doc_ids", "doc_tokens", "first_rule", "rules", "symbols").mapInArrow(
        decoded, "part long, seq long, doc_id long, local_start long, n_tokens long, ids_crc32 long"
    )
    # ids before each part (one row a part), then before each shard within its part
    sizes = files.select("part", "seq", "n_tokens")
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("held")).select("part", total("held").alias("part_start"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(parts, "part").select("part", "seq", (F.col("part_start") + total("n_tokens")).alias("shard_start"))
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def grammar_of(row) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols) of a shard's row."""
    rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 3)
    kind = "<u2" if row["first_rule"] + len(rules) <= 1 << 16 else "<u4"
    return rules, np.frombuffer(row["symbols"], kind)


def read_document(row, position: int) -> np.ndarray:
    """Ids of one document of a shard's row, decoded alone."""
    rules, symbols = grammar_of(row)
    tables = expansions(rules, row["first_rule"])
    ends = np.cumsum(tables[2][symbols])
    stop = int(np.sum(row["doc_tokens"][: position + 1]))
    first = np.searchsorted(ends, stop - row["doc_tokens"][position], side="right")
    return expand(symbols[first : np.searchsorted(ends, stop) + 1], tables)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/token_files/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder)


QUERIES = {"op7_token_files": op7_token_files}
CHECKS: dict[str, str] = {}
