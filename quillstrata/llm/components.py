"""Connected components of an undirected graph, by large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrata.llm.common import discard, spool


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a vertex is linked to the least of the vertex and its neighbours; small: every neighbour below it, and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    if large:
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("x"), "m")
    else:
        out = both.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    return out.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (bigint).  v, root for each vertex that has an edge; root is the least vertex of its component.

    Rounds go on until nothing changes; their number grows with the logarithm of the longest path.  Each is written to the shared
    folder, as is the result.  A hub is never gathered: its edges meet one row that holds its minimum."""
    edges = spool(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, now = None, ()
    while now != before:
        before, last = now, edges
        edges = spool(_stars(_stars(last, large=True), large=False), "stars")
        discard(last)
        now = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
    members = edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = spool(members.union(edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()), "found")
    discard(edges)
    return found
