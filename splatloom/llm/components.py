"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import written


#: Tasks over which the edges of one node are dealt when they meet its smallest neighbour.
SALTS = 8


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round: each node points its larger (or its smaller) neighbours at its smallest neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"]).drop("salt")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; the component is its smallest node.

    Null ends and self-links are ignored.  Each round is two group-bys over the edges, written to
    the shared folder, so nothing is gathered in one place; rounds grow with the logarithm of the
    longest chain.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    mark = None
    while True:
        edges = written(_star(_star(edges, large=True), large=False), "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(edges.select("b", "b").distinct())
