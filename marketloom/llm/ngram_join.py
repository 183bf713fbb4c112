"""Jaccard join of word n-gram sets by rare-first prefixes, with length, positional and suffix filters.

*Order.* n-grams (64-bit hashes) are ordered rare first: by the count of their cell, then by
hash. All n-grams of all rows are counted, in ``CELLS`` cells of the hash; a common n-gram
stands out from the rare ones that share its cell. Any total order keeps the join exact; this
one keeps common n-grams out of the prefixes.

*Prefix.* Two sets as similar as wanted share an n-gram among the first ones of each, as many
as the set may miss and one more. Rows of equal sets are one node; nodes meet in the posting
lists of their prefix n-grams.

*Length and position.* An n-gram at place i of a set of n leaves at most n - i n-grams to
share, which bounds the size of a partner by ``reach``. Two members of a list can be similar
only if each one's size is within the other's reach. So one of the two must reach its own size
(it is ``early``), and lists are cut into bands of sizes: a member meets those of its own
band and, as a ``guest``, those of the next smaller one.

*Links.* First each node meets the member of its lists with the fewest n-grams before the
shared one; this joins most groups by one link a node.
In each list that still holds two components, the members of different ones are met in
blocks. Lists carry no sets: a pair that passes length and position is tried by the suffix
filter (the n-grams after a prefix are counted in ranges of the hash; the smaller counts of
each range bound what is shared there), and the pairs left, each once, are verified on the
whole sets. Only sets of such pairs are kept and shuffled, cut from the texts anew; all other
members are known by their range counts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marketloom.llm.graph import components
from marketloom.session import cut_lineage

WIDTH = 3
SIMILARITY = Fraction(90, 100)
#: Cells of the n-gram counts, a power of two (8 bytes each on the driver and each worker).
CELLS = 1 << 20
#: Bits of the filter of nodes whose sets are wanted, a power of two; it passes others, which a join then drops.
FILTER_BITS = 1 << 26
#: Ranges of the hash in which the suffix filter counts, a power of two.
RANGES = 64
#: Members of a list in one block; a task compares two blocks at a time.
BLOCK_ROWS = 1024
#: Rows that meet one copy of a set in a join.
FAN = 1024
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_HELD = 500_000
_SPACES = bytes(range(0x09, 0x0E))
_TABLE = bytes(0x20 if b in _SPACES else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scattering of 64-bit numbers."""
    for shift, factor in ((32, 0x9E3779B97F4A7C15), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(32))


_LETTERS = _mixed(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x94D049BB133111EB


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2 ** 64 and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def _hashed_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: differences of running sums of a polynomial in the letters."""
    letters = np.frombuffer(text.translate(_TABLE), np.uint8)
    powers, inverse = _powers(1 << max(PIECE, len(text)).bit_length())
    inside = np.concatenate(([False], letters != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_LETTERS[letters] * powers[: len(text)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def _long_text(text: bytes, piece: int) -> np.ndarray:
    """Word hashes of a long text, a bounded piece at a time."""
    parts, start, step = [], 0, piece
    while start < len(text):
        part = text[start : start + step]
        if start + step < len(text):
            end = part.translate(_TABLE).rfind(b" ")
            if end < 0:  # one word fills the piece
                step *= 2
                continue
            part = part[:end]
        parts.append(_hashed_words(part)[0])
        start, step = start + len(part) + 1, piece
    return np.concatenate(parts)


def _gram_sets(words: np.ndarray, sizes: list[int], width: int) -> Iterator[np.ndarray]:
    """The set of each text from the word hashes of all, of which each text holds so many."""

    def folded(h: np.ndarray, n: int) -> np.ndarray:
        grams = np.full(max(0, len(h) - n + 1), n, np.uint64)
        for k in range(n):
            grams = _mixed(grams) + h[k : k + len(grams)]
        return _mixed(grams)

    grams, at = folded(words, width), 0
    for n in sizes:
        own = grams[at : at + n - width + 1] if n >= width else folded(words[at : at + n], n)[: min(n, 1)]
        own = np.sort(own)
        yield own[np.concatenate(([True], own[1:] != own[:-1]))] if len(own) else own
        at += n


def sets_of(texts: Iterable[bytes | None], width: int = WIDTH, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Ascending distinct hashes of the n-grams of each text (UTF-8); of fewer words, one hash of them all.

    Short texts are hashed together, about ``piece`` bytes at a time, long ones in pieces.
    """

    def closed(held: list[bytes]) -> Iterator[np.ndarray]:
        words, starts = _hashed_words(b" ".join(held))
        ends = np.cumsum([len(t) + 1 for t in held])
        return _gram_sets(words, np.diff(np.searchsorted(starts, ends), prepend=0).tolist(), width)

    held, size = [], 0
    for text in texts:
        text = text or b""
        if held and size + len(text) > piece:
            yield from closed(held)
            held, size = [], 0
        if len(text) > piece:
            words = _long_text(text, piece)
            yield from _gram_sets(words, [len(words)], width)
        else:
            held.append(text)
            size += len(text) + 1
    if held:
        yield from closed(held)


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return (text.as_py() for text in column)


def number_of(s: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    x = xxh64_intdigest(s.tobytes())
    return x - (1 << 64) if x >> 63 else x


def set_numbers(docs: DataFrame, keep: tuple[str, ...], width: int = WIDTH) -> DataFrame:
    """The columns ``keep`` with ``node`` (a hash of the whole set) and ``n`` (its size) of each ``text``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = [], []
            for s in sets_of(_texts(batch.column(len(keep))), width):
                nodes.append(number_of(s))
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], names=[*keep, "node", "n"]
            )

    columns = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, F.col("text").cast("binary")).mapInArrow(hashed, ", ".join([*columns, "node long", "n long"]))


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all arrays of each block."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"]
    )


def cell_counts(docs: DataFrame, width: int = WIDTH, cells: int = CELLS) -> np.ndarray:
    """How many n-grams of all rows of ``text`` (distinct in a row) fall into each cell of the hash.

    Each task counts in one array and sends it by blocks, which are summed in as many tasks.
    """
    block = min(cells, 4096)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for s in sets_of(_texts(batch.column(0)), width):
                np.add.at(total, _cell(s, cells), 1)
        rows = total.reshape(-1, block)
        held = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([rows[k].tobytes() for k in held], pa.binary())], names=["block", "counts"]
        )

    sent = docs.select(F.col("text").cast("binary")).mapInArrow(counted, "block int, counts binary")
    total = np.zeros((cells // block, block), np.int64)
    for k, counts in sent.repartition("block").mapInArrow(_block_sums, "block int, counts binary").collect():  # one row a block
        total[k] = np.frombuffer(counts, np.int64)
    return total.reshape(-1)


def _cell(grams: np.ndarray, cells: int) -> np.ndarray:
    return (grams >> np.uint64(64 - (cells.bit_length() - 1))).view(np.int64) if cells > 1 else np.zeros(len(grams), np.int64)


def rare_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set, n-grams of rare cells first."""
    return s[np.lexsort((s, counts[_cell(s, len(counts))]))]


def node_filter(nodes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each remainder of ``node`` that occurs, in words of 64."""
    found = np.zeros(bits // 64, np.uint64)
    rows = nodes.select(F.pmod("node", F.lit(bits)).alias("held")).selectExpr("cast(held div 64 as int) as at", "shiftleft(1L, cast(held % 64 as int)) as bit")
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most a row a word
    found[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return found


def least_shared(n: int, similarity: Fraction) -> int:
    """n-grams that a set of n shares at least with any set as similar."""
    return -(-similarity.numerator * n // similarity.denominator)


def reach(similarity: Fraction) -> Column:
    """Greatest size of a set similar to one of ``n`` that shares no n-gram before ``place`` (from 0)."""
    p, q = similarity.numerator, similarity.denominator
    return F.expr(f"cast(n - place as long) * {p + q} div {p} - n")


def postings(docs: DataFrame, counts, width: int, similarity: Fraction) -> DataFrame:
    """(gram, node, n, place) of each prefix n-gram of each distinct set, dealt out by gram."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            nodes, sizes, first = [], [], []
            for s in sets_of(_texts(batch.column(0)), width):
                node = number_of(s)
                if not len(s) or node in seen:
                    continue
                if len(seen) < _HELD:  # copies beyond are folded after the shuffle
                    seen.add(node)
                nodes.append(node)
                sizes.append(len(s))
                first.append(rare_first(s, counts.value)[: len(s) - least_shared(len(s), similarity) + 1].view(np.int64))
            many = [len(x) for x in first]
            columns = [
                np.concatenate([*first, np.zeros(0, np.int64)]),
                np.repeat(np.array(nodes, np.int64), many),
                np.repeat(np.array(sizes, np.int32), many),
                np.concatenate([*map(np.arange, many), np.zeros(0, np.int64)]).astype(np.int32),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "node", "n", "place"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(posted, "gram long, node long, n int, place int")
    return rows.repartition("gram").groupBy("gram", "node").agg(*(F.first(c).alias(c) for c in ("n", "place")))


def listed_members(rows: DataFrame, similarity: Fraction) -> DataFrame:
    """(gram, band, own, node, n, place, reach): the members of lists and bands in which a pair may be similar."""
    rows = rows.withColumn("reach", reach(similarity))
    # most n-grams have one member, so that lists are chosen where the postings lie, before any is written
    lists = Window.partitionBy("gram")
    early = F.max((F.col("reach") >= F.col("n")).cast("int")).over(lists)
    rows = rows.withColumns({"members": F.count("*").over(lists), "early": early}).where("members > 1 and early = 1")
    rows = cut_lineage(rows.drop("members", "early"))
    # a thousandth wider than the similarity allows sizes to differ, so that they differ by one band at most
    own = F.floor(F.log("n") / F.lit(-1.001 * math.log(similarity)))
    rows = rows.withColumn("band", F.explode(F.array(own, own - 1))).withColumn("own", F.col("band") == own)
    live = rows.groupBy("gram", "band").agg(
        F.count("*").alias("members"), F.max(F.when(F.col("own"), F.col("reach") - F.col("n"))).alias("spare"), F.min(F.when(F.col("own"), F.col("n"))).alias("least")
    )
    live = live.where("members > 1 and spare >= 0").select("gram", "band", "least")
    # no member of a band is smaller than its least own one
    return rows.join(live, ["gram", "band"]).where(F.col("reach") >= F.col("least")).drop("least")


def range_counts(s: np.ndarray) -> np.ndarray:
    return np.bincount(_cell(s, RANGES), minlength=RANGES).astype(np.int32)


def _chosen_sets(batches: Iterator[pa.RecordBatch], wanted, width: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """(node, set) of the distinct sets of each batch that pass the filter."""
    bits, seen = wanted.value, set()
    for batch in batches:
        rows = []
        for s in sets_of(_texts(batch.column(0)), width):
            node = number_of(s)
            at = node % (64 * len(bits))
            if node in seen or not int(bits[at >> 6]) >> (at & 63) & 1:
                continue
            if len(seen) < _HELD:
                seen.add(node)
            rows.append((node, s))
        yield rows


def _rows_of(nodes: DataFrame, docs: DataFrame, rows, names: list[str], filter_bits: int) -> DataFrame:
    """A written table of node and binary columns that ``rows`` makes of each distinct set in ``nodes``."""
    context = docs.sparkSession.sparkContext
    nodes = cut_lineage(nodes.distinct())
    wanted = context.broadcast(node_filter(nodes, filter_bits))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches, wanted):
            columns = columns or [()] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["node", *names])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(made, ", ".join(["node long", *(f"{c} binary" for c in names)]))
    return cut_lineage(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]))


def count_rows(nodes: DataFrame, docs: DataFrame, width: int, counts, similarity: Fraction, filter_bits: int = FILTER_BITS) -> DataFrame:
    """node, whole and tail of each set: its n-grams counted in ranges, and those after its prefix."""

    def counted(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[list]:
        for rows in _chosen_sets(batches, wanted, width):
            tails = [rare_first(s, counts.value)[len(s) - least_shared(len(s), similarity) + 1 :] for _, s in rows]
            yield list(zip(*((node, range_counts(s).tobytes(), range_counts(tail).tobytes()) for (node, s), tail in zip(rows, tails))))

    return _rows_of(nodes, docs, counted, ["whole", "tail"], filter_bits)


def set_rows(nodes: DataFrame, docs: DataFrame, width: int, filter_bits: int = FILTER_BITS) -> DataFrame:
    """node and set (ascending hashes) of each set."""

    def kept(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[list]:
        for rows in _chosen_sets(batches, wanted, width):
            yield list(zip(*((node, s.tobytes()) for node, s in rows)))

    return _rows_of(nodes, docs, kept, ["set"], filter_bits)


def may_be_similar(pairs: DataFrame, counts: DataFrame, similarity: Fraction) -> DataFrame:
    """Those pairs (a, n, place, b, m, spot) that pass the suffix filter, as (a, b); they share the n-gram at these places."""
    p, q = similarity.numerator, similarity.denominator

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, place, m, spot = (batch.column(k).to_numpy().astype(np.int64) for k in range(2, 6))
            whole, tail, whole_b, tail_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.int32).reshape(-1, RANGES) for k in range(6, 10))
            most = n - (-(-p * n // q)) + 1 - place + np.minimum(whole_b, tail).sum(axis=1, dtype=np.int64)
            most = np.minimum(most, m - (-(-p * m // q)) + 1 - spot + np.minimum(tail_b, whole).sum(axis=1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(most * (p + q) >= p * (n + m))).columns[:2], names=["a", "b"])

    columns = ["a", "b", "n", "place", "m", "spot"]
    rows = pairs.join(counts.withColumnRenamed("node", "a"), "a").select(*columns, "whole", "tail")
    other = counts.select(F.col("node").alias("b"), F.col("whole").alias("whole_b"), F.col("tail").alias("tail_b"))
    return rows.join(other, "b").select(*columns, "whole", "tail", "whole_b", "tail_b").mapInArrow(passed, "a long, b long")


def enough_shared(x: np.ndarray, y: np.ndarray, similarity: Fraction) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * (similarity.numerator + similarity.denominator) >= similarity.numerator * (len(x) + len(y))


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction, fan: int = FAN) -> DataFrame:
    """The pairs (a, b) whose sets are similar. A ``b`` of many pairs is dealt out in copies of its set."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            hit = [enough_shared(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in both]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(hit, pa.bool_())).columns[:2], names=["a", "b"])

    copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / fan).alias("copies"))
    # few sets have more than one copy, so that the numbers of copies are joined to the pairs without their sets
    pairs = pairs.join(copies, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies")))
    centres = copies.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    centres = centres.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    one = sets.select(F.col("node").alias("a"), F.col("set").alias("x"))
    return pairs.join(one, "a").join(centres, ["b", "copy"]).select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def _candidates(rows: list[tuple], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes among members of one or two blocks of a list that pass all filters."""
    nodes, roots, block, own, place, n, reach = (np.array(c, np.int64) for c in list(zip(*rows))[:7])
    whole, tail = (np.frombuffer(b"".join(r[k] for r in rows), np.int32).reshape(len(rows), -1) for k in (7, 8))
    p, q = similarity.numerator, similarity.denominator
    # n-grams of the prefix that can still be shared
    ahead = n - (-(-p * n // q)) + 1 - place
    two, left, right = len(set(block.tolist())) > 1, [], []
    for k in range(len(rows) - 1):
        rest = slice(k + 1, None)
        met = (n[rest] <= reach[k]) & (n[k] <= reach[rest]) & (roots[rest] != roots[k]) & ((own[rest] | own[k]) > 0)
        if two:
            met &= block[rest] != block[k]
        near = np.flatnonzero(met) + k + 1
        if len(near):
            most = ahead[k] + np.minimum(whole[near], tail[k]).sum(axis=1, dtype=np.int64)
            most = np.minimum(most, ahead[near] + np.minimum(tail[near], whole[k]).sum(axis=1, dtype=np.int64))
            near = near[most * (p + q) >= p * (n[near] + n[k])]
            left.append(np.full(len(near), nodes[k]))
            right.append(nodes[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([*left, none]), np.concatenate([*right, none])


def met_in_lists(members: DataFrame, sets: DataFrame, similarity: Fraction, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct pairs (a < b) of members (gram, band, own, node, root, n, place, reach) that pass all filters.

    Members of one root are no pair. Blocks of a long list meet two by two, each two in a
    group of their own, so that a task holds two blocks.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found = None, [], []

        def sent() -> pa.RecordBatch:
            a, b = (np.concatenate([np.zeros(0, np.int64), *(pair[k] for pair in found)]) for k in range(2))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for group, row in zip(zip(*(c.to_pylist() for c in batch.columns[:4])), zip(*(c.to_pylist() for c in batch.columns[4:]))):
                if group != key:
                    if len(held) > 1:
                        found.append(_candidates(held, similarity))
                    key, held = group, []
                held.append(row)
            yield sent()
        if len(held) > 1:
            found.append(_candidates(held, similarity))
        yield sent()

    blocks = members.groupBy("gram", "band").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))
    rows = members.join(blocks, ["gram", "band"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = ["gram", "band", "i", "j"]
    kept = [*group, "node", "root", "block", "own", "place", "n", "reach"]
    rows = rows.select(*kept).join(sets, "node").select(*kept, "whole", "tail").repartition(*group)
    return rows.sortWithinPartitions(*group, "node").mapInArrow(compared, "a long, b long").distinct()


def similar_sets(
    docs: DataFrame, width: int = WIDTH, similarity: Fraction = SIMILARITY, block_rows: int = BLOCK_ROWS, cells: int = CELLS, filter_bits: int = FILTER_BITS
) -> DataFrame:
    """(node, root) of the set of every row of ``text`` that has a link."""
    context = docs.sparkSession.sparkContext
    counts = context.broadcast(cell_counts(docs, width, cells))
    members = cut_lineage(listed_members(postings(docs, counts, width, similarity), similarity))
    tallies = count_rows(members.select("node"), docs, width, counts, similarity, filter_bits)

    def similar(pairs: DataFrame) -> DataFrame:
        # the sets of pairs left are cut once more, as those of all members would fill the disk
        pairs = cut_lineage(pairs)
        return verified(pairs, set_rows(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, width, filter_bits), similarity)

    # the member with the fewest n-grams before the shared one lacks the others' rare ones
    ends = members.where("own").groupBy("gram", "band").agg(F.min(F.struct("place", "node", "n", "reach")).alias("end"))
    met = members.join(ends, ["gram", "band"])
    met = met.where((F.col("node") != F.col("end.node")) & (F.col("n") <= F.col("end.reach")) & (F.col("end.n") <= F.col("reach")))
    tried = met.groupBy("node").agg(F.min(F.struct("end.place", "end.node", F.col("end.n").alias("m"), F.col("n"), F.col("place").alias("own_place"))).alias("end"))
    tried = tried.select(F.col("node").alias("a"), "end.n", F.col("end.own_place").alias("place"), F.col("end.node").alias("b"), "end.m", F.col("end.place").alias("spot"))
    found = cut_lineage(similar(may_be_similar(tried, tallies, similarity)))
    rooted = members.join(cut_lineage(components(found)), "node", "left").withColumn("root", F.coalesce("root", "node"))
    ends = rooted.groupBy("gram", "band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram", "band")
    left = cut_lineage(rooted.join(ends, ["gram", "band"]))
    return components(found.union(similar(met_in_lists(left, tallies, similarity, block_rows))))


def ngram_components(docs: DataFrame, width: int = WIDTH, similarity: Fraction = SIMILARITY, **bounds: int) -> DataFrame:
    """doc_id, n_shingles, component_id and component_size of each row of ``doc_id``, ``text``.

    Two rows link when their sets of ``width``-word n-grams have Jaccard similarity of at least
    ``similarity``; a text of fewer words is one n-gram, and null texts and texts without words
    link with nothing (each is its own component). A component's id is the least ``doc_id`` in
    it; null ids stay null and name no component unless all in it are null. Repeated rows come
    out as often. Other columns are not read. Empty in, empty out.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    numbers = cut_lineage(set_numbers(rows, ("doc_id",), width))
    nodes = numbers.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    found = similar_sets(rows, width, similarity, **bounds)
    nodes = nodes.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("component_size"))
    nodes = nodes.join(groups, "root").select("node", "component_id", "component_size")
    linked = numbers.where("n > 0").join(nodes, "node")
    alone = numbers.where("n = 0").withColumns({"component_id": F.col("doc_id"), "component_size": F.lit(1).cast("long")})
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "component_size"]
    return linked.select(*columns).unionAll(alone.select(*columns))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id")


OP12_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS s
  FROM words
), classes AS MATERIALIZED (
  SELECT md5(array_to_string(s, chr(10))) AS k, any_value(s) AS s, any_value(len(s)) AS n, min(doc_id) AS first_id
  FROM sets WHERE len(s) > 0 GROUP BY 1
), grams AS MATERIALIZED (
  SELECT first_id, n, unnest(s) AS g FROM classes
), links AS MATERIALIZED (
  SELECT a.first_id AS a, b.first_id AS b
  FROM grams a JOIN grams b ON a.g = b.g AND a.first_id <> b.first_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY a.first_id, a.n, b.first_id, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reached AS (
  SELECT first_id AS node, first_id AS root FROM classes
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.node
), roots AS (
  SELECT node, min(root) AS component_id FROM reached GROUP BY 1
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(r.component_id, s.doc_id) AS component_id
FROM sets s
LEFT JOIN classes c ON len(s.s) > 0 AND c.k = md5(array_to_string(s.s, chr(10)))
LEFT JOIN roots r ON r.node = c.first_id
"""

QUERIES = {"op12_ngram_join": op12_ngram_join}
CHECKS = {"op12_ngram_join": OP12_SQL}
