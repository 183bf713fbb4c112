"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, the ``prefix`` nearest of
``pivots`` (a bounded sample of distinct vectors). Each block of rows holds an inverted
file: for each pivot, the rows that have it among their nearest and its place there. A
query reads the files of its own nearest pivots and adds up, row by row, what each shared
pivot takes off Spearman's footrule distance (missing pivots stand at place ``prefix``);
the share ``candidates`` of the block at the least footrule is reranked by the exact inner
product of the original vectors, and so is every row of nearly the same permutation, however
many there are: in a dense group the permutations are too alike to choose by.

Copies of a vector are indexed once, with the k + 1 smallest of their ids: no other copy can
be among the k nearest of any query. Distinct vectors are dealt to blocks by a hash, queries
likewise, and every block of queries meets every block of rows once; no block grows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.session import cut_lineage

PIVOTS = 512
PREFIX = 128
CANDIDATES = 0.05
LEAST_CANDIDATES = 200
#: Rows whose gain is at least this share of the largest possible are reranked in any number.
CLOSE = 0.6
BLOCK_ROWS = 4096
BLOCK_QUERIES = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one row per non-null id whose vector is finite, without nulls and not all zero.

    Of rows that repeat an id, the least vector stands.
    """
    v = F.col(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & F.coalesce(whole, F.lit(False)) & F.exists(v, lambda x: x != 0))
    return rows.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v.cast("array<double>")).alias("v"))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, alike: float = 0.7) -> np.ndarray:
    """Pivots from a sample of eight times as many distinct vectors, the first by a hash.

    A vector whose cosine with a chosen pivot is over ``alike`` is passed over: pivots from
    one dense group would all say the same.
    """
    order = F.xxhash64(F.lit(11), "v")
    found = np.array([r.v for r in rows.select("v").orderBy(order, "v").limit(8 * pivots).collect()], float)
    if not len(found):
        return found
    unit = found / np.linalg.norm(found, axis=1, keepdims=True)
    chosen: list[int] = []
    open_ = np.ones(len(found), bool)
    for k in range(len(found)):
        if open_[k] and len(chosen) < pivots:
            chosen.append(k)
            open_ &= unit @ unit[k] <= alike
    return found[chosen]


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The places of the ``prefix`` nearest pivots, nearest first, ties to the earlier pivot."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


class PermutationIndex:
    """Inverted files of one block of distinct vectors, each with the ids of its copies."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        self.ids, self.vectors, self.pivots = ids, vectors, pivots
        self.prefix = min(prefix, len(pivots))
        near = nearest_pivots(vectors, pivots, self.prefix)
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        self.rows = (order // self.prefix).astype(np.int32)
        self.places = (order % self.prefix).astype(np.int16)
        self.starts = np.searchsorted(flat[order], np.arange(len(pivots) + 1))

    def gains(self, near: np.ndarray) -> np.ndarray:
        """Half of what the shared pivots take off the footrule distance, for each row."""
        starts, ends = self.starts[near], self.starts[near + 1]
        slices = [slice(a, b) for a, b in zip(starts.tolist(), ends.tolist())]
        rows = np.concatenate([self.rows[s] for s in slices])
        places = np.concatenate([self.places[s] for s in slices])
        own = np.repeat(np.arange(len(near), dtype=np.int16), ends - starts)
        return np.bincount(rows, weights=self.prefix - np.maximum(places, own), minlength=len(self.ids))

    def search(self, query_id: int, query: np.ndarray, near: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates of the block, best first."""
        n = len(self.ids)
        wanted = min(n, max(k + 1, least, math.ceil(share * n)))
        if wanted < n:
            # least footrule first, ties to the earlier row: one number orders both
            gains = self.gains(near)
            order = -gains.astype(np.int64) * n + np.arange(n)
            chosen = np.argpartition(order, wanted - 1)[:wanted]
            close = gains >= CLOSE * self.prefix * (self.prefix + 1) / 2
            if np.count_nonzero(close) > np.count_nonzero(close[chosen]):
                chosen = np.union1d(chosen, np.flatnonzero(close))
        else:
            chosen = np.arange(n)
        scores = self.vectors[chosen] @ query
        # copies score alike, so k + 1 vectors hold the k best ids besides the query's own
        best = chosen[np.argsort(-scores, kind="stable")]
        scores = np.sort(scores)[::-1]
        if len(scores) > k + 1:
            best = best[scores >= scores[k]]
            scores = scores[: len(best)]
        sizes = [len(self.ids[b]) for b in best]
        ids = np.array([i for b in best for i in self.ids[b]], np.int64)
        scores = np.repeat(scores, sizes)[ids != query_id]
        ids = ids[ids != query_id]
        first = np.lexsort((ids, -scores))[:k]
        return ids[first], scores[first]


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str,
    vector_col: str,
    k: int = 20,
    pivots: int = PIVOTS,
    prefix: int = PREFIX,
    share: float = CANDIDATES,
    least: int = LEAST_CANDIDATES,
    block_rows: int = BLOCK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank (from 1), id, score: the k largest inner products found for each query.

    A query's own id is no candidate; ties go to the smaller id; fewer candidates than k are
    all returned. Vectors null, all zero, or with null or non-finite components take no part,
    neither do null ids; a repeated id counts once. Other columns are not read. Without
    usable vectors there are no rows.
    """
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).groupBy("v").agg(F.collect_list("id").alias("ids"))
    rows, asked = cut_lineage(rows), cut_lineage(asked)
    n, m = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    points = choose_pivots(rows, pivots)

    def dealt(side: DataFrame, by: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        every = F.sequence(F.lit(0), F.lit(other_blocks - 1))
        return side.withColumn(own, F.pmod(F.xxhash64(F.lit(5), by), F.lit(own_blocks)).cast("int")).withColumn(other, F.explode(every))

    def cell(index: pa.Table, block: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if index.num_rows and block.num_rows and len(points):
            file = PermutationIndex(index["ids"].to_pylist(), _matrix(index["v"]), points, prefix)
            wanted = _matrix(block["v"])
            near = nearest_pivots(wanted, points, file.prefix)
            for q, query, own in zip(block["id"].to_pylist(), wanted, near):
                ids, scores = file.search(q, query, own, k, share, least)
                for column, values in zip(out, ([q] * len(ids), ids.tolist(), scores.tolist())):
                    column += values
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds)], names=["query_id", "id", "score"])

    left = dealt(rows, "v", "row_block", row_blocks, "query_block", query_blocks)
    right = dealt(asked, "id", "query_block", query_blocks, "row_block", row_blocks)
    keys = ["row_block", "query_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(len(column), -1)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = nearest(vectors, vectors.where("vec_id % 20 = 0"), "vec_id", "embedding")
    return found.withColumnRenamed("id", "vec_id")


QUERIES = {"op6_neighbours": op6_neighbours}
CHECKS: dict[str, str] = {}
