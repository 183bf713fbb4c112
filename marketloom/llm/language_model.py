"""Bigram language model by deleted interpolation.

P(w | v) = l2 c(v w) / c(v .) + l1 c(w) / N + l0 / (V + 1): maximum-likelihood estimates
over the training texts, mixed with weights that depend on the bucket of the context's
frequency (powers of two of c(v .)). The weights are learned by expectation-maximisation on
deleted counts: every training token is predicted from the counts without itself. The
uniform part covers the V words and one further symbol, which stands for every unknown
word. A text begins from the end symbol and ends with it.

The counts are never in one place. Documents are encoded into blocks: the distinct hashed
words of a block, sorted, and the token stream as places in them; blocks are stored in
buckets, so that what meets them later is all that moves. Each block sends its distinct
words and bigrams, with its training counts, to the ranges of the hash; a range sums the
blocks' counts and answers each block with the totals of just its keys. The vocabulary
size and N come from the same sums. All of this is compressed arrays in rows of bounded
size, and grows with the text. Words have 64-bit keys; bigrams as many bits as the tokens
have, and ``PAIR_BITS`` more: about one in a million shares its count with another.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.quality import held_out
from marketloom.session import cut_lineage, shared_folder

#: Text of a block, in bytes; the documents of a block are scored by one task.
BLOCK_BYTES = 8_000_000
#: Distinct keys that a range of the hash holds on average.
RANGE_KEYS = 2_000_000
PAIR_BITS = 20
BUCKETS = 48
#: Rounds of expectation-maximisation.
ROUNDS = 40
CACHE_WORDS = 400_000
END_WORD = b""

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, 3)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_WORDS = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, lower-cased (A-Z), and then of the end symbol."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END_WORD)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def bigram_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; at ``first`` places that is the end symbol."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first] = np.uint64(_WORDS[END_WORD])
    x = (before * _MIX) ^ ((hashes >> np.uint64(32)) | (hashes << np.uint64(32)))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def squeeze(values: np.ndarray) -> bytes:
    """An array of unsigned numbers, bytes of one weight together, compressed."""
    import zstandard

    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype(np.uint8)
    planes = values.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes((kind.itemsize,)) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(data: bytes, dtype=np.int64) -> np.ndarray:
    import zstandard

    size = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}")[:, 0].astype(dtype) if planes.size else np.zeros(0, dtype)


def squeeze_keys(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys, as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data, np.uint64), dtype=np.uint64)


BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, keys binary, places binary"


def encode_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents (``doc_id``, ``text``, ``held``): sorted distinct words, each token's place in them."""
    names = ["block", "doc_ids", "held", "sizes", "keys", "places"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        ids, held, tokens, filled, block = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            distinct, places = np.unique(np.concatenate(tokens), return_inverse=True)
            values = (part + block, ids, held, [len(t) for t in tokens], squeeze_keys(distinct), squeeze(places))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            for doc_id, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                ids.append(doc_id)
                held.append(out)
                tokens.append(word_hashes(text))
                filled += len(text or "") + 1
                if filled >= block_bytes:
                    yield close()
                    ids, held, tokens, filled, block = [], [], [], 0, block + 1
        if ids:
            yield close()

    return docs.select("doc_id", "text", "held").mapInArrow(encode, BLOCK)


def stored_by(df: DataFrame, key: str) -> DataFrame:
    """The table written to the shared folder in buckets of the key: joins by it do not move it."""
    name = f"stored_{uuid.uuid4().hex}"
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.format("parquet").option("path", f"{shared_folder(df.sparkSession)}/tables/{name}")
    writer.bucketBy(buckets, key).saveAsTable(name)
    return df.sparkSession.table(name)


class Block:
    """A block's tokens: hashes, the places of words and of bigrams among the distinct ones."""

    def __init__(self, row: dict, pair_bits: int):
        self.sizes = np.array(row["sizes"])
        self.ends = np.cumsum(self.sizes)
        self.first = self.ends - self.sizes
        self.held = np.repeat(np.array(row["held"], bool), self.sizes)
        self.words, self.word_places = unsqueeze_keys(row["keys"]), unsqueeze(row["places"])
        pairs = bigram_hashes(self.words[self.word_places], self.first) >> np.uint64(64 - pair_bits)
        self.pairs, self.pair_places = np.unique(pairs, return_inverse=True)

    def trained(self, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.bincount(places[~self.held], minlength=len(keys)).astype(np.int64)


def exchange_counts(blocks: DataFrame, ranges: int, pair_bits: int) -> DataFrame:
    """(block, order, range, totals, distinct, tokens): training totals of each block's keys.

    ``ranges`` is a power of two: the leading bits of a key say where it is counted.
    """
    bits = ranges.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block = Block(row, pair_bits)
                for order, keys, places, width in ((0, block.words, block.word_places, 64), (1, block.pairs, block.pair_places, pair_bits)):
                    trained = block.trained(places, keys)
                    edges = np.searchsorted(keys >> np.uint64(width - bits), np.arange(ranges + 1, dtype=np.uint64))
                    for r in np.flatnonzero(np.diff(edges)).tolist():
                        own = slice(edges[r], edges[r + 1])
                        values = (row["block"], order, r, squeeze_keys(keys[own]), squeeze(trained[own]))
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, sent_kinds)], names=sent_names)

    def total(table: pa.Table) -> pa.Table:
        keys = [unsqueeze_keys(k.as_py()) for k in table["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        distinct, places = np.unique(np.concatenate(keys), return_inverse=True)
        trained = np.concatenate([unsqueeze(t.as_py()) for t in table["trained"]])
        sums = np.bincount(places, weights=trained, minlength=len(distinct)).astype(np.int64)
        answers = [squeeze(sums[places[e - len(k) : e]]) for k, e in zip(keys, ends)]
        n = table.num_rows
        return pa.table(
            [table["block"], table["order"], table["range"], pa.array(answers, pa.binary()), pa.array([int((sums > 0).sum())] * n, pa.int64()), pa.array([int(sums.sum())] * n, pa.int64())],
            names=["block", "order", "range", "totals", "distinct", "tokens"],
        )

    sent_names = ["block", "order", "range", "keys", "trained"]
    sent_kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    sent = blocks.mapInArrow(send, "block long, order int, range int, keys binary, trained binary")
    return sent.groupBy("order", "range").applyInArrow(total, "block long, order int, range int, totals binary, distinct long, tokens long")


class Scored:
    """The counts of a block's tokens: of each token, of its context and of the two together."""

    def __init__(self, row: dict, answers: list[dict], pair_bits: int):
        block = Block(row, pair_bits)
        self.sizes, self.first, self.held = block.sizes, block.first, block.held
        totals = []
        for order in range(2):
            parts = sorted((a["range"], a["totals"]) for a in answers if a["order"] == order)
            totals.append(np.concatenate([unsqueeze(t) for _, t in parts]))
        self.word, self.pair = totals[0][block.word_places], totals[1][block.pair_places]
        # a word precedes as often as it occurs; the end symbol precedes the first words
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[self.first] = self.word[block.ends[0] - 1]


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def parts_of(word, pair, context, tokens: int, vocabulary: int, deleted: bool) -> np.ndarray:
    """Bigram, unigram and uniform estimates of each token; ``deleted``: without the token itself."""
    own = 1 if deleted else 0
    bigram = np.maximum(pair - own, 0) / np.maximum(context - own, 1)
    return np.stack((bigram, np.maximum(word - own, 0) / max(tokens - own, 1), np.full(len(word), 1 / (vocabulary + 1))))


#: Logarithmic cells of the two ratios that EM needs, for each context bucket.
CELLS = 256


def statistics(scored: Scored, tokens: int, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, sums) of the deleted estimates of a block's training tokens.

    A token's share in EM depends on its bucket and on bigram / uniform and unigram /
    uniform alone; tokens are counted by bucket and the logarithms of these, an eighth of
    a power of two a cell, and the sums keep the cells' mean ratios exact.
    """
    use = ~scored.held
    word, pair, context = scored.word[use], scored.pair[use], scored.context[use]
    bigram, unigram, uniform = parts_of(word, pair, context, tokens, vocabulary, True)
    cell = lambda r: np.where(r > 0, np.clip(np.floor(8 * np.log2(np.maximum(r, 1e-30))) + 64, 1, CELLS - 1), 0).astype(np.int64)
    a, b = bigram / uniform, unigram / uniform
    code = (bucket_of(context - 1) * CELLS + cell(a)) * CELLS + cell(b)
    found, places = np.unique(code, return_inverse=True)
    sums = np.stack([np.bincount(places, weights=w, minlength=len(found)) for w in (np.ones(len(a)), a, b)], axis=1).astype(float)
    return found, sums


def learn_weights(cells: np.ndarray, sums: np.ndarray, buckets: int = BUCKETS, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights (buckets, 3) of bigram, unigram and uniform by expectation-maximisation.

    A bucket without held-out tokens takes the weights learned over all buckets; an unseen
    context has no bigram part.
    """
    bucket = cells // (CELLS * CELLS)
    n = sums[:, 0]
    ratios = np.stack((sums[:, 1] / n, sums[:, 2] / n, np.ones(len(n))), axis=1) if len(n) else np.zeros((0, 3))

    def run(rows: np.ndarray) -> np.ndarray:
        weights = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = ratios[rows] * weights
            share /= share.sum(axis=1, keepdims=True)
            weights = (share * n[rows, None]).sum(axis=0) + 1e-9
            weights /= weights.sum()
        return weights

    common = run(np.arange(len(n))) if len(n) else np.array([0.0, 0.0, 1.0])
    weights = np.tile(common, (buckets, 1))
    for k in range(buckets):
        rows = np.flatnonzero(bucket == k)
        if len(rows):
            weights[k] = run(rows)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def score_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    ``docs`` has ``doc_id``, ``text`` and the flag ``held``: rows that teach nothing. A null
    or empty text is the end symbol alone. Null ids and repeated rows stay, and count as
    often as they occur. Other columns are not read. Without training rows every estimate
    but the uniform one is nothing. Empty in, empty out.
    """
    spark = docs.sparkSession
    blocks = stored_by(encode_blocks(docs, block_bytes), "block")
    occurrences = blocks.agg(F.sum(F.expr("aggregate(sizes, 0L, (a, s) -> a + s)"))).first()[0] or 0
    ranges = 1 << max(2, int(occurrences // range_keys).bit_length())
    pair_bits = min(64, int(occurrences).bit_length() + PAIR_BITS)
    answers = cut_lineage(exchange_counts(blocks, ranges, pair_bits))
    known = {
        r["order"]: r
        for r in answers.select("order", "range", "distinct", "tokens").distinct().groupBy("order").agg(F.sum("distinct").alias("distinct"), F.sum("tokens").alias("tokens")).collect()
    }
    tokens, vocabulary = (known[0]["tokens"], known[0]["distinct"]) if known else (0, 0)

    def gathered(table: pa.Table) -> pa.Table:
        found, sums = [], []
        for block, parts in _meeting(table):
            cells, own = statistics(Scored(block, parts, pair_bits), tokens, vocabulary)
            found.append(cells)
            sums.append(own)
        cells, own = np.concatenate(found), np.concatenate(sums)
        return pa.table([pa.array(cells), *(pa.array(own[:, k]) for k in range(3))], names=["cell", "n", "a", "b"])

    met = _meet(blocks, answers)
    cells = met.applyInArrow(lambda left, right: gathered((left, right)), "cell long, n double, a double, b double")
    rows = cells.groupBy("cell").agg(F.sum("n"), F.sum("a"), F.sum("b")).orderBy("cell").toLocalIterator()  # 48 x 256 x 256 cells at most
    table = np.array([list(r) for r in rows], float).reshape(-1, 4)
    weights = learn_weights(table[:, 0].astype(np.int64), table[:, 1:])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], [], [], []]
        for block, parts in _meeting((left, right)):
            s = Scored(block, parts, pair_bits)
            mix = weights[np.minimum(bucket_of(s.context), BUCKETS - 1)]
            p = (parts_of(s.word, s.pair, s.context, tokens, vocabulary, False) * mix.T).sum(axis=0)
            base = np.log10((s.word + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
            per_doc = lambda v: np.add.reduceat(v, s.first)
            values = (block["doc_ids"], block["held"], s.sizes.tolist(), per_doc((s.word > 0).astype(np.int64)).tolist(), per_doc(base).tolist(), per_doc(np.log10(p)).tolist())
            for column, value in zip(columns, values):
                column += value
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = met.applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _meet(blocks: DataFrame, answers: DataFrame):
    return blocks.groupBy("block").cogroup(answers.select("block", "order", "range", "totals").groupBy("block"))


def _meeting(tables: tuple[pa.Table, pa.Table]) -> Iterator[tuple[dict, list[dict]]]:
    left, right = tables
    parts = right.to_pylist()
    for k in range(left.num_rows):
        block = left.slice(k, 1).to_pylist()[0]
        yield block, [p for p in parts if p["block"] == block["block"]]


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs.select("doc_id", "text", held_out("doc_id", 5, 1).alias("held")))


QUERIES = {"op8_language_model": op8_language_model}
CHECKS: dict[str, str] = {}
