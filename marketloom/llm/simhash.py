"""SimHash fingerprints of word shingles and bit-sliced comparison of them.

*Fingerprints.* Texts are lower-cased (A-Z), split at ASCII white space and hashed by
shingle (XXH64, seed 42); a bit is set if over half of the hashes, repeats included, set it.

*Comparison.* Distinct fingerprints are compared within buckets. A bucket is stored as bit
planes: plane j holds bit j of 64 fingerprints in each machine word. For a block of queries
one exclusive-or a plane updates the distances to a whole word of fingerprints in carry-save
counters; a block is abandoned once every distance in it exceeds the radius. Planes that are
constant in a bucket cost nothing. A bucket reports a spanning forest of its links (each
fingerprint with the least one of its local component), never its pairs.

*Buckets.* ``linked`` finds every pair within a small radius r: the 64 bits fall into r + 2
blocks, and fingerprints within r agree on two blocks at least. A bucket with over
``hot_bucket`` members is split again by two of the blocks that remain, so that it is bounded
by the bits that are left. ``linked_wide`` and ``alike_members`` are for larger radii on longer
fingerprints: tables of sampled bits, as many as the wanted recall takes.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import jaccard
from marketloom.llm.graph import components
from marketloom.session import cut_lineage

SEED = 42
RADIUS = 2
HOT_BUCKET = 4096
#: Words of the fingerprints of near copies.
WORDS = 3
#: Sets of so many shingles or fewer differ in more bits than larger ones that are as similar.
FEW = 5
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of each shingle of the text; none without words, one with fewer than ``width``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [xxh64_intdigest(joined, SEED)]
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    shingles = map(joined.__getitem__, map(slice, starts, [e - 1 for e in ends[width - 1 :]]))
    return list(map(xxh64_intdigest, shingles, itertools.repeat(SEED)))


def majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprint of each of ``n`` owners from its hashes: bits set in over half of them."""
    sizes = np.bincount(owner, minlength=n)
    rows = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((n, 64), bool)
    for k in range(8):
        values = np.bincount(owner * 256 + rows[:, k], minlength=n * 256).reshape(n, 256)
        bits[:, 8 * k : 8 * k + 8] = 2 * (values @ _BITS) > sizes[:, None]
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)[:, 0]


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of a shingle from its first one, by multiplying and shifting."""
    if k == 0:
        return hashes
    x = hashes ^ np.uint64(_MULTIPLIERS[0] * k & (1 << 64) - 1)
    for m in _MULTIPLIERS[1:]:
        x = (x ^ (x >> np.uint64(29))) * np.uint64(m)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, width: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",), distinct: bool = False) -> DataFrame:
    """The columns ``keep`` and ``f0`` .. of ``words`` 64-bit fingerprints for each row.

    ``distinct``: a shingle counts once however often it is repeated.

    Null and empty texts, and texts without words, have fingerprint zero. Repeated rows stay.
    """
    columns = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), *(f"f{k} long" for k in range(words))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints: list[np.ndarray] = []
            hashes, sizes = [], []

            def close() -> None:
                h = np.array(hashes, np.uint64)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                prints.append(np.stack([majority(mixed(h, k), owner, len(sizes)) for k in range(words)], axis=1))

            for text in batch.column(len(keep)):
                found = shingle_hashes(text.as_py(), width)
                found = set(found) if distinct else found
                hashes += found
                sizes.append(len(found))
                if len(hashes) > 200_000 or len(sizes) >= 512:
                    close()
                    hashes, sizes = [], []
            if sizes:
                close()
            table = np.concatenate(prints).view(np.int64) if prints else np.zeros((0, words), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(table[:, k]) for k in range(words))],
                names=[*keep, *(f"f{k}" for k in range(words))],
            )

    return docs.select(*keep, "text").mapInArrow(hashed, columns)


def bits_of(prints: np.ndarray) -> np.ndarray:
    """Bits (members, 64 a word) of fingerprints (members, words)."""
    return np.unpackbits(np.ascontiguousarray(prints).astype(">u8").view(np.uint8), axis=1)


def bit_planes(bits: np.ndarray) -> np.ndarray:
    """Planes (bits, machine words): member i is bit i of each plane."""
    padded = np.zeros((bits.shape[1], -(-len(bits) // 64) * 64), np.uint8)
    padded[:, : len(bits)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, members: int, radius: int, abandon_every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) for each pair at ``radius`` or fewer differing bits; queries are rows of bits."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.zeros((len(queries), planes.shape[1]), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros_like(counters[0])
    flips = np.where(queries.T == 1, ones, np.uint64(0))
    for used, (plane, flip) in enumerate(zip(planes, flips), 1):
        carry = flip[:, None] ^ plane[None, :]
        for counter in counters:
            counter ^= carry
            carry &= ~counter
        over |= carry
        if used % abandon_every == 0 and used > radius and (_exceeds(counters, over, radius) == ones).all():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = ~_exceeds(counters, over, radius)
    found = np.unpackbits(near.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :members]
    return np.nonzero(found)


def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: a comparison from the highest counter bit down."""
    more, equal = over.copy(), ~over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            more |= equal & counters[k]
            equal &= ~counters[k]
    return more


def forest(prints: np.ndarray, radius: int, block: int = 2048, queries: int = 256) -> np.ndarray:
    """Index of the least member of each member's component under links within the radius."""
    n, label = len(prints), np.arange(len(prints))
    bits = bits_of(prints)
    bits = bits[:, (bits != bits[:1]).any(axis=0)]
    if not bits.shape[1]:
        return np.zeros(n, np.int64)
    for lo in range(0, n, block):
        planes = bit_planes(bits[lo : lo + block])
        for at in range(lo, n, queries):
            a, b = within(bits[at : at + queries], planes, min(block, n - lo), radius)
            label = merged(label, a + at, b + lo)
    return label


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: the least index of each component."""
    a, b = a[a != b], b[a != b]
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def bucket_links(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, row) within buckets; rows of a bucket stand together.

    Buckets of under 64 members do not fill one machine word of a plane; their words are
    compared directly, all such buckets at once.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, n))
    found_a, found_b = [], []
    for at, size in zip(starts[sizes >= 64].tolist(), sizes[sizes >= 64].tolist()):
        label = forest(prints[at : at + size], radius)
        moved = np.flatnonzero(label != np.arange(size))
        found_a.append(moved + at)
        found_b.append(label[moved] + at)
    left = np.repeat(np.where(sizes < 64, sizes, 0), sizes) - (np.arange(n) - np.repeat(starts, sizes))  # members from here on
    rows = np.flatnonzero(left > 1)
    step = 1
    while len(rows):
        apart = np.bitwise_count(prints[rows] ^ prints[rows + step]).sum(axis=1, dtype=np.int64)
        hit = rows[apart <= radius]
        found_a.append(hit + step)
        found_b.append(hit)
        step += 1
        rows = rows[left[rows] > step]
    return np.concatenate(found_a or [starts[:0]]), np.concatenate(found_b or [starts[:0]])


def _by_bucket(rows: DataFrame, words: int, found: Callable, names: tuple[str, str], batch_rows: int) -> DataFrame:
    """What ``found`` (of keys, nodes and prints; two columns) gives for rows (bucket, node, f0 ..), which are dealt by bucket here."""
    read = ["bucket", "node", *(f"f{k}" for k in range(words))]

    def sent(table: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found(table[:, 0], table[:, 1], np.ascontiguousarray(table[:, 2:]).view(np.uint64))], names=[*names])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + words), np.int64)
        for batch in batches:
            held = np.concatenate((held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
            if len(held) < batch_rows:
                continue
            last = np.flatnonzero(held[:, 0] == held[-1, 0])[0]  # all but the last bucket, which may go on
            if last:
                yield sent(held[:last])
                held = held[last:]
        if len(held):
            yield sent(held)

    # by node too: a group of near copies then has much the same least member in all its buckets
    dealt = rows.select(*read).repartition("bucket").sortWithinPartitions("bucket", "node")
    return dealt.mapInArrow(compared, ", ".join(f"{c} long" for c in names))


def _links_of_buckets(rows: DataFrame, words: int, radius: int, batch_rows: int = 200_000) -> DataFrame:
    """Links (a, b) between ``node``s of rows (bucket, node, f0 ..)."""

    def links(keys: np.ndarray, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = bucket_links(keys, prints, radius)
        return node[a], node[b]

    return _by_bucket(rows, words, links, ("a", "b"), batch_rows)


def linked(prints: DataFrame, radius: int = RADIUS, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b): links that join every two distinct values of ``f0`` within the radius.

    ``prints`` holds distinct 64-bit values. Exact: two values within r agree on two of
    r + 2 blocks. Buckets of one member go no further; hot ones are split by two more blocks.
    """
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]

    def part(lo: int, hi: int):
        return F.shiftrightunsigned("f0", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))

    def keyed(cuts: list[tuple[int, int]], salt: int):
        """A bucket number for each pair of blocks; different pairs have different seeds."""
        return [F.xxhash64(F.lit(salt + i), part(*x), part(*y)) for i, (x, y) in enumerate(itertools.combinations(cuts, 2))]

    cuts = list(itertools.pairwise(edges))
    tables = list(itertools.combinations(range(blocks), 2))
    # the bits outside a table's two blocks, cut into blocks again, for hot buckets
    finer = []
    for t, (x, y) in enumerate(tables):
        rest = [(lo + (hi - lo) * h // 2, lo + (hi - lo) * (h + 1) // 2) for k, (lo, hi) in enumerate(cuts) if k not in (x, y) for h in range(2)]
        rest = _grouped(rest, blocks)
        keys = [F.xxhash64(F.lit(1000 * (t + 1) + i), F.col("bucket"), *(part(*z) for z in (*p, *q))) for i, (p, q) in enumerate(itertools.combinations(rest, 2))]
        finer.append(F.array(*keys))
    rows = prints.select("f0", F.posexplode(F.array(*keyed(cuts, 1))).alias("t", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    rows = rows.join(sizes, "bucket")
    split = F.element_at(F.array(*finer), F.col("t") + 1)
    rows = rows.select("f0", F.explode(F.when(F.col("members") > hot_bucket, split).otherwise(F.array("bucket"))).alias("bucket"))
    return _links_of_buckets(rows.withColumn("node", F.col("f0")), 1, radius)


def _grouped(pieces: list, blocks: int) -> list[list]:
    """Pieces of bits dealt into so many blocks."""
    return [pieces[k::blocks] for k in range(min(blocks, len(pieces)))]


def simhash_components(docs: DataFrame, width: int = 3, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id and component_size of each row of ``doc_id``, ``text``.

    Rows are linked when their fingerprints differ in ``radius`` bits or fewer, texts without
    words (fingerprint zero) like any other; a component is what links reach, and its id the
    least ``doc_id`` in it. Null ids stay null and give no component its id unless all are
    null. Repeated rows come out as often. Other columns are not read. Empty in, empty out.
    """
    prints = cut_lineage(fingerprints(docs, width))
    nodes = prints.groupBy("f0").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    found = components(linked(nodes.select("f0"), radius))
    roots = nodes.join(found, nodes.f0 == found.node, "left").select(
        "f0", F.coalesce("root", "f0").alias("root"), "first_id", "copies"
    )
    groups = roots.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("component_size"))
    roots = roots.join(groups, "root").select("f0", "component_id", "component_size")
    return prints.join(roots, "f0").select(
        "doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id", "component_size"
    )


def flip_share(similarity: float) -> float:
    """Expected share of differing bits for two sets of this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def linked_wide(prints: DataFrame, words: int, similarity: float, recall: float = 0.98, slack: float = 0.02, seed: int = 9, fold: int = 32_768) -> DataFrame:
    """(a, b): links between ``node``s whose fingerprints f0 .. tell of this similarity or more.

    Fingerprints meet in tables of sampled bits: about the logarithm of the rows less two,
    and 16 at least; as many tables as give ``recall`` for a pair at the threshold itself.
    They are linked at up to the share of differing bits expected there, plus ``slack``.
    A bucket of over ``fold`` rows is dealt into blocks of about so many, and each two blocks
    meet in a bucket of their own, so that all members are compared in bounded memory.
    """
    n = prints.count()
    apart = flip_share(similarity)
    bits = max(16, n.bit_length() - 2)
    tables = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits))
    rng = np.random.default_rng(seed)
    keys = []
    for t in range(tables):
        masks = [0] * words
        for bit in rng.choice(64 * words, bits, replace=False).tolist():
            masks[bit // 64] |= 1 << (bit % 64)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys.append(F.xxhash64(F.lit(t), *(F.col(f"f{k}").bitwiseAND(F.lit(m)) for k, m in enumerate(signed) if m)))
    rows = prints.select("node", *(f"f{k}" for k in range(words)), F.explode(F.array(*keys)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    rows = jaccard.block_cells(rows.join(sizes, "bucket"), F.ceil(F.col("members") / fold), "node")
    rows = rows.withColumn("bucket", F.xxhash64("bucket", "cell"))
    return _links_of_buckets(rows, words, math.floor((apart + slack) * 64 * words), batch_rows=min(200_000, fold))


def differing(n: int, m: int, both: int) -> float:
    """Probability that a bit differs for sets of n and m random hashes, so many of them in both."""

    def more(k: int, least: int) -> float:
        return sum(math.comb(k, x) for x in range(max(0, least), k + 1)) / 2**k

    total = 0.0
    for k in range(both + 1):
        x, y = more(n - both, n // 2 + 1 - k), more(m - both, m // 2 + 1 - k)
        total += math.comb(both, k) / 2**both * (x * (1 - y) + y * (1 - x))
    return total


@functools.lru_cache
def worst_share(similarity: float, lo: int, hi: int) -> float:
    """The greatest of ``flip_share`` and of the shares of two sets as similar, the smaller of ``lo`` to ``hi`` hashes."""
    s, worst = Fraction(similarity).limit_denominator(10_000), flip_share(similarity)
    for n in range(lo, hi + 1):
        for m in range(n, int(n / s) + 1):
            both = math.ceil(s * (n + m) / (1 + s))
            if both <= n:
                worst = max(worst, differing(n, m, both))
    return worst


def radius_of(total: int, share: float, lost: float) -> int:
    """The least number of bits that is exceeded with no greater probability than ``lost``, each of ``total`` differing with this share."""
    seen = 0.0
    for d in range(total + 1):
        seen += math.comb(total, d) * share**d * (1 - share) ** (total - d)
        if seen >= 1 - lost:
            return d
    return total


def tables_for(total: int, bits: int, share: float, radius: int, recall: float) -> int:
    """Tables of so many sampled bits that let a pair within the radius meet with this probability, over all numbers of differing bits."""
    cases = [
        (math.comb(total, d) * share**d * (1 - share) ** (total - d), 1 - math.comb(total - d, bits) / math.comb(total, bits))
        for d in range(radius + 1)
    ]

    def met(tables: int) -> float:
        return sum(p * (1 - apart**tables) for p, apart in cases)

    hi = 1
    while met(hi) < recall:
        hi *= 2
    lo = hi // 2 + 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if met(mid) >= recall else (mid + 1, hi)
    return hi


def alike_members(prints: DataFrame, words: int, similarity: float, recall: float, fold: int = HOT_BUCKET, seed: int = 9) -> DataFrame:
    """(bucket, node): any two ``node``s of sets as similar share a bucket with probability ``recall``.

    ``prints`` holds distinct nodes with ``hashes`` (the size of the set) and the fingerprint f0 ...
    Fingerprints meet in tables of sampled bits: about the logarithm of the rows less nine, so
    that chance fills a bucket with some hundred rows. Within a bucket of a table those that
    links within the radius reach make a bucket of the result; equal ones come out once.
    A bucket of over ``fold`` rows is dealt into blocks, each two of which meet.
    """
    total, bits = 64 * words, max(6, prints.count().bit_length() - 9)
    few, other = worst_share(similarity, 1, FEW), worst_share(similarity, FEW + 1, 4 * FEW)
    radius = radius_of(total, max(few, other), (1 - recall) / 4)
    usual, most = (tables_for(total, bits, share, radius, recall) for share in (other, max(few, other)))
    rng, keys = np.random.default_rng(seed), []
    for t in range(most):
        masks = [0] * words
        for bit in rng.choice(total, bits, replace=False).tolist():
            masks[bit // 64] |= 1 << (bit % 64)
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        keys.append(F.xxhash64(F.lit(t), *(F.col(f"f{k}").bitwiseAND(F.lit(m)) for k, m in enumerate(signed) if m)))
    small = F.col("hashes") <= math.floor(FEW / similarity)
    buckets = F.when(small, F.array(*keys)).otherwise(F.array(*keys[:usual]))
    rows = prints.select("node", *(f"f{k}" for k in range(words)), F.explode(buckets).alias("bucket"))
    hot = cut_lineage(rows.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > fold))
    rows = rows.join(hot, "bucket", "left")
    rows = jaccard.block_cells(rows, F.ceil(F.coalesce("members", F.lit(1)) / fold), "node")

    def groups(keys: np.ndarray, node: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        label = merged(np.arange(len(node)), *bucket_links(keys, prints, radius))
        order = np.argsort(label, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(label[order]) != 0)))
        sizes = np.diff(np.append(starts, len(order)))
        content = np.add.reduceat(mixed(node[order].view(np.uint64), 1), starts).view(np.int64)  # the same for the same members
        kept = np.repeat(sizes > 1, sizes)
        return np.repeat(content, sizes)[kept], node[order][kept]

    rows = rows.withColumn("bucket", F.xxhash64("bucket", "cell"))
    return _by_bucket(rows, words, groups, ("bucket", "node"), 100_000).distinct()


def near_copy_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5, recall: float = 0.999, **blocks: int) -> DataFrame:
    """doc_id, text_hash, copies and ``keeper`` for each distinct (doc_id, text) of ``docs``.

    Groups are what links of near copies reach: a link is a pair of sets of five-word shingles
    whose Jaccard similarity was found to be ``similarity`` or more; ``recall`` is the least
    probability that the SimHash fingerprints of such a pair bring it there. The keeper of a group is the row with the least
    ``doc_id`` (nulls last), then the least hash of the text; ``copies`` says how often that
    row occurs. Texts without words are copies of each other. Other columns are not read.
    Empty in, empty out.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = cut_lineage(jaccard.signatures(hashed, width, WORDS, ("doc_id", "text_hash")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    # one set has one number and one fingerprint
    nodes = cut_lineage(rows.groupBy("node").agg(first.alias("first"), *(F.max(c).alias(c) for c in ("hashes", *(f"f{k}" for k in range(WORDS))))))

    def texts(wanted: DataFrame) -> DataFrame:
        """(node, text) of each wanted node, from the row that is its first."""
        reps = nodes.join(wanted, "node").select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
        same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
        return hashed.join(reps, same).select("node", "text").dropDuplicates(["node"])

    members = cut_lineage(alike_members(nodes.where("hashes > 0").drop("first"), WORDS, similarity, recall))
    found = jaccard.similar_components(members, texts, width, similarity, **blocks)
    roots = nodes.select("node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keepers = roots.groupBy("root").agg(F.min("first").alias("best")).select("best.doc_id", "best.text_hash", F.lit(True).alias("keeper"))
    distinct = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies"))
    same = distinct.doc_id.eqNullSafe(keepers.doc_id) & (distinct.text_hash == keepers.text_hash)
    return distinct.join(keepers, same, "left").select(distinct.doc_id, distinct.text_hash, "copies", F.coalesce("keeper", F.lit(False)).alias("keeper"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_simhash": op5_simhash}
CHECKS: dict[str, str] = {}
