"""Hierarchical packing of documents into token windows of several lengths.

Within each task, documents are routed to tiers by length. The longest tier takes its
documents first: whole windows are cut from documents that fill them, and what is left of
a document opens a window. The gap of an open window is filled with the longest document
of the shorter tiers that fits whole, again and again; when none fits, the next one is
cut and its rest goes back to its tier. The tokens left at the end of a task fill windows
of the shorter tiers (powers of two, hence without padding), and only what is under the
shortest tier is padded. Windows are then dealt into step groups: sorted by attention cost
(the sum of the squares of their pieces) and dealt back and forth, so that the groups of a
task cost about the same.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tokens import chunk_ids, encode_text

TIERS = (2048, 1024, 512, 256)
STEP_WINDOWS = 16
#: Tokens that one packing round of a task holds.
ROUND_TOKENS = 8_000_000

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "window long, tier long, step_group long"
)


class Tier:
    """Documents by remaining length; the longest one within a limit is found by bits."""

    def __init__(self, longest: int):
        self.by_length: dict[int, list] = defaultdict(list)
        self.bits = 0
        self.longest = longest

    def put(self, length: int, item) -> None:
        self.by_length[length].append(item)
        self.bits |= 1 << length

    def take(self, most: int):
        """The longest item of at most so many tokens, or None."""
        length = (self.bits & ((2 << most) - 1)).bit_length() - 1
        if length <= 0:
            return None
        items = self.by_length[length]
        item = items.pop()
        if not items:
            self.bits &= ~(1 << length)
        return item


def pack(lengths: Sequence[int], tiers: Sequence[int] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (padded length, pieces of (document, start, length)) that hold every token once."""
    window = tiers[0]
    windows: list[tuple[int, list]] = []
    pool = Tier(window)  # all tiers; a tier is a range of its lengths
    for doc, n in enumerate(lengths):
        whole = n // window * window
        windows += [(window, [(doc, at, window)]) for at in range(0, whole, window)]
        if n > whole:
            pool.put(n - whole, (doc, whole, n - whole))
    rest: list[tuple[int, int, int]] = []
    while (item := pool.take(window)) is not None:
        pieces, gap = [item], window - item[2]
        while gap and (short := pool.take(gap)) is not None:
            pieces.append(short)
            gap -= short[2]
        while gap and (longer := pool.take(window)) is not None:
            doc, at, n = longer
            cut = min(gap, n)
            pieces.append((doc, at, cut))
            gap -= cut
            if n > cut:
                pool.put(n - cut, (doc, at + cut, n - cut))
        if gap:
            rest = pieces
        else:
            windows.append((window, pieces))
    for tier in (*tiers[1:], 0):
        while sum(n for _, _, n in rest) >= max(1, tier):
            room, pieces = tier or window, []
            while room and rest:
                doc, at, n = rest.pop(0)
                cut = min(room, n)
                pieces.append((doc, at, cut))
                room -= cut
                if n > cut:
                    rest.insert(0, (doc, at + cut, n - cut))
            windows.append((tier or window, pieces))
    return windows


def step_groups(windows: Sequence[tuple[int, list]], size: int = STEP_WINDOWS) -> list[int]:
    """Group of each window: windows of one length, dealt back and forth by attention cost."""
    groups, used = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [i for i, (t, _) in enumerate(windows) if t == tier]
        own.sort(key=lambda i: -sum(n * n for _, _, n in windows[i][1]))
        k = -(-len(own) // size)
        for at, i in enumerate(own):
            turn, place = divmod(at, k)
            groups[i] = used + (place if turn % 2 == 0 else k - 1 - place)
        used += k
    return groups


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    tiers: Sequence[int] = TIERS,
    step_windows: int = STEP_WINDOWS,
    round_tokens: int = ROUND_TOKENS,
    payload: Sequence[str] = (),
) -> DataFrame:
    """One row per piece of ``doc_id``, ``text``; the columns of ``payload`` come along.

    ``tiers`` fall from the window length by powers of two. A null or empty text is its end
    id alone. Repeated rows, null ids and other columns are kept as they are; every token of
    every row lies in one piece. An empty table gives no piece. Ids of sequences and step
    groups are unique, not consecutive: the task's number is in their upper bits.
    """
    from pyspark.sql.types import StructField, StructType

    types = [docs.schema[c] for c in payload]
    out = StructType([*_schema().fields, *(StructField(f"payload_{f.name}", f.dataType) for f in types)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, high = chunk_ids(tokenizer), TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held = next_window = next_group = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_window, next_group
            windows = pack([len(r[1]) // 4 for r in rows], tiers)
            groups = step_groups(windows, step_windows)
            columns: list[list] = [[] for _ in names]
            for i, (window, pieces) in enumerate(windows):
                offset = 0
                for doc, at, n in pieces:
                    row = rows[doc]
                    ids = memoryview(row[1])[4 * at : 4 * (at + n)]
                    values = (row[0], at, n, zlib.crc32(ids), len(row[1]) // 4, high + next_window + i, offset, window, _tier(len(row[1]) // 4, tiers), high + next_group + groups[i], *row[2:])
                    for column, value in zip(columns, values):
                        column.append(value)
                    offset += n
            next_window += len(windows)
            next_group += max(groups, default=-1) + 1
            for lo in range(0, len(columns[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 5000], k) for c, k in zip(columns, kinds)], names=names)

        kinds = [pa.int64()] * 10
        names = [f.name for f in out]
        for batch in batches:
            kinds[10:] = [batch.schema.field(2 + i).type for i in range(len(types))]
            more = [batch.column(2 + i).to_pylist() for i in range(len(types))]
            for k, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1))):
                rows.append((doc_id, encode_text(cache, text.as_py()), *(m[k] for m in more)))
                held += len(rows[-1][1]) // 4
                if held >= round_tokens:
                    yield from flush()
                    rows, held = [], 0
        if rows:
            yield from flush()

    return docs.select("doc_id", "text", *payload).mapInArrow(packed, out)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(PIECES)


def _tier(tokens: int, tiers: Sequence[int]) -> int:
    """The shortest tier that holds the document, else the longest."""
    return min((t for t in tiers if t >= tokens), default=tiers[0])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_packing": op2_packing}
CHECKS: dict[str, str] = {}
