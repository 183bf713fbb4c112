"""Links between texts whose sets of word shingles have a given Jaccard similarity, verified.

*Candidates* come from SimHash fingerprints of the sets (``simhash.alike_members``). Nothing
else decides which pairs are looked at.

*Verification.* A link is a pair whose shingle sets (64-bit hashes) were compared whole.
First each set meets the least and then the greatest set of its buckets, which joins most
groups by one link a set. In every bucket that still holds two components all pairs are
compared. A bucket over the bounds is dealt into blocks, and each two blocks meet in a task
of their own, so tasks are bounded and no member is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm.caches import forget
from marketloom.llm.graph import components
from marketloom.session import cut_lineage

#: A task compares two blocks of about so many sets and hashes each.
BLOCK_ROWS = 1024
BLOCK_HASHES = 1_000_000
_RARE = 32


def _set_of(text: str | None, width: int) -> np.ndarray:
    from marketloom.llm.simhash import shingle_hashes

    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _number(s: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, width: int, words: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep``, ``node`` (a hash of the whole shingle set), ``hashes`` (their number) and fingerprint ``f0`` .. of each row's ``text``."""
    names = ["node", "hashes", *(f"f{k}" for k in range(words))]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from marketloom.llm.simhash import majority, mixed

        forget()

        def prints(sets: list[np.ndarray]) -> np.ndarray:
            h, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            return np.stack([majority(mixed(h, k), owner, len(sets)) for k in range(words)], axis=1).view(np.int64)

        for batch in batches:
            nodes, sizes, table, sets = [], [], [], []
            for text in batch.column(len(keep)):
                sets.append(_set_of(text.as_py(), width))
                nodes.append(_number(sets[-1]))
                sizes.append(len(sets[-1]))
                if sum(sizes[-len(sets) :]) > 200_000 or len(sets) >= 512:
                    table.append(prints(sets))
                    sets = []
            if sets:
                table.append(prints(sets))
            table = np.concatenate(table) if table else np.zeros((0, words), np.int64)
            arrays = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), *(pa.array(table[:, k]) for k in range(words))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=[*keep, *names])

    columns = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, "text").mapInArrow(hashed, ", ".join([*columns, *(f"{c} long" for c in names)]))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """node, hashes (their number) and set (ascending 64-bit hashes) of each row of ``node``, ``text``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set_of(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["node", "hashes", "set"],
            )

    return texts.select("node", "text").mapInArrow(hashed, "node long, hashes long, set binary")


def similar_pairs(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of sets (of distinct hashes) of this Jaccard similarity or more."""
    n, share = len(sets), Fraction(similarity).limit_denominator(10_000)
    p, q = share.numerator, share.denominator
    sizes = np.array([len(s) for s in sets], np.int64)
    h, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(h)))
    common = np.zeros((n, n), np.int64)
    # hashes of few sets count pair by pair, those of many as products of 0/1 matrices
    column = np.repeat(np.where(counts <= _RARE, -1, np.cumsum(counts > _RARE) - 1), counts)
    left = np.where(column < 0, np.repeat(counts, counts) - (np.arange(len(h)) - np.repeat(starts, counts)), 0)
    rows, step = np.flatnonzero(left > 1), 1
    while len(rows):
        common += np.bincount(owner[rows] * n + owner[rows + step], minlength=n * n).reshape(n, n)
        step += 1
        rows = rows[left[rows] > step]
    many = int((counts > _RARE).sum())
    for lo in range(0, many, 4096):
        here = (column >= lo) & (column < lo + 4096)
        held = np.zeros((n, min(4096, many - lo)), np.float32)
        held[owner[here], column[here] - lo] = 1
        common += np.rint(held @ held.T).astype(np.int64)
    near = np.triu(common * (p + q) >= p * (sizes[:, None] + sizes[None, :]), 1)
    return np.nonzero(near)


def _links(rows: Iterator[tuple], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning links (node, node) of the pairs among rows (node, set)."""
    from marketloom.llm.simhash import merged

    nodes, sets = zip(*rows)
    label = merged(np.arange(len(nodes)), *similar_pairs([np.frombuffer(s, np.uint64) for s in sets], similarity))
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return [nodes[k] for k in moved], [nodes[k] for k in label[moved]]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share = Fraction(similarity).limit_denominator(10_000)
        for batch in batches:
            hit = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both * (share.numerator + share.denominator) >= share.numerator * (len(x) + len(y)))
            kept = batch.filter(pa.array(hit, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("set").alias("y"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def block_cells(rows: DataFrame, blocks, member: str) -> DataFrame:
    """The rows with ``cell``: 0 where there is one block, else once for each other block.

    ``blocks`` is the number of blocks of the row's ``bucket``. Any two members of a bucket
    share a cell, and a cell holds two blocks.
    """
    own = F.pmod(F.xxhash64(member, F.lit(3)), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("own"))
    cells = F.transform(others, lambda k: F.least(k, F.col("own")) * F.col("blocks") + F.greatest(k, F.col("own")))
    rows = rows.withColumn("blocks", blocks.cast("long")).withColumn("own", own)
    cells = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(cells)
    return rows.withColumn("cell", F.explode(cells)).drop("blocks", "own")


def _compared(members: DataFrame, sets: DataFrame, similarity: float, block_rows: int, block_hashes: int) -> DataFrame:
    """Links of all pairs in each bucket of members (bucket, node)."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            a, b = [], []
            for bucket, cell, node, one in zip(*(c.to_pylist() for c in batch.columns)):
                if (bucket, cell) != key:
                    if len(held) > 1:
                        x, y = _links(held, similarity)
                        a, b = a + x, b + y
                    key, held = (bucket, cell), []
                held.append((node, one))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        if len(held) > 1:
            a, b = _links(held, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sized = members.join(sets.select("node", "hashes"), "node")
    buckets = sized.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("hashes").alias("hashes"), F.bit_xor(F.xxhash64("node")).alias("content"))
    # buckets of the same members are compared once
    buckets = buckets.groupBy("members", "hashes", "content").agg(F.min("bucket").alias("bucket"))
    blocks = F.ceil(F.greatest(F.col("members") / block_rows, F.col("hashes") / block_hashes, F.lit(1)))
    rows = block_cells(members.join(buckets, "bucket"), blocks, "node").select("bucket", "cell", "node")
    dealt = rows.join(sets, "node").select("bucket", "cell", "node", "set").repartition("bucket", "cell")
    return dealt.sortWithinPartitions("bucket", "cell", "node").mapInArrow(compared, "a long, b long")


def similar_components(
    members: DataFrame,
    texts: Callable[[DataFrame], DataFrame],
    width: int,
    similarity: float,
    block_rows: int = BLOCK_ROWS,
    block_hashes: int = BLOCK_HASHES,
) -> DataFrame:
    """(node, root) of every node that has a verified link to another of its bucket.

    ``members`` is a written table of (bucket, node); ``texts`` gives (node, text) for a table of nodes.
    """
    sets = cut_lineage(shingle_sets(texts(members.select("node").distinct()), width))
    left, found, roots = members, None, None
    for end in (F.min, F.max):
        ends = left.groupBy("bucket").agg(end("node").alias("b"))
        tried = left.join(ends, "bucket").where("node <> b").groupBy("node").agg(end("b").alias("b"))
        links = cut_lineage(_verified(tried.select(F.col("node").alias("a"), "b"), sets, similarity))
        found = links if found is None else found.union(links)
        roots = cut_lineage(components(found))
        rooted = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
        open_ = rooted.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
        left = cut_lineage(members.join(open_, "bucket").select("bucket", "node"))
    return components(found.union(_compared(left, sets, similarity, block_rows, block_hashes)))
