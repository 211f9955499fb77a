"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    others = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its smallest node.

    Each round links a node to the smallest neighbour it sees, until nothing
    moves; rounds grow with the logarithm of the longest chain.
    """
    kept = cut_lineage(_clean(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    mark = _mark(kept)
    while True:
        kept = cut_lineage(_clean(_small_star(_clean(_large_star(kept)))))
        new = _mark(kept)
        if new == mark:
            break
        mark = new
    members = kept.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(kept.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
