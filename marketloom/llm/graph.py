"""Connected components of links between 64-bit nodes, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b); root is the component's least node.

    Each link is first moved to its ends' least neighbours, which leaves few links in a dense
    group; a component's least node is its own label there. Then alternating star rounds: each node hands its neighbours its least neighbour. The number
    of rounds grows with the logarithm of the longest path. Minima are aggregated before
    the shuffle; each round's table goes to the shared folder. No links give no rows.
    """
    edges = cut_lineage(_oriented(links))
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = cut_lineage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")).select(F.col("a").alias("node"), "p"))
    moved = edges.join(label.select(F.col("node").alias("a"), F.col("p").alias("x")), "a")
    moved = moved.join(label.select(F.col("node").alias("b"), F.col("p").alias("y")), "b")
    found = _stars(_oriented(moved.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    found = found.select(F.col("node").alias("p"), "root")
    return label.join(found, "p", "left").select("node", F.coalesce("root", "p").alias("root"))


def _oriented(links: DataFrame) -> DataFrame:
    """Distinct links between different nodes, the greater one first."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _stars(edges: DataFrame) -> DataFrame:
    edges = cut_lineage(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = least.select("a", F.col("m").alias("b")).union(large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = cut_lineage(small.where("a <> b").distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
