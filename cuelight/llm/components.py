"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelight.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction: each node's larger (or smaller) neighbours, and itself, move to its smallest one."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return near.join(least, "a").filter("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node of edges(a, b), longs, that isn't the smallest of its component, with that smallest one.

    Self loops and repeated edges don't matter. Each round's edges are a written table; nothing but a checksum
    comes to the driver. Rounds grow with the logarithm of the longest path.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    edges, before = written(edges, "edges"), None
    while True:
        check = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if check == before or not check[0]:
            return edges
        before = check
        edges = written(_stars(_stars(edges, True), False), "edges")
