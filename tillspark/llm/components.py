"""Connected components by alternating large-star and small-star rounds.

Each round rewrites the edge list so that every node points to a smaller node;
rounds shrink the diameter geometrically and stop when nothing changes.  All
state is a table of edges in the shared folder; no node's neighbours are
gathered (minima are partial aggregates, hubs are joined, which adaptive
execution can split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillspark.llm.common import scratch_table


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
        ).first()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """Undirected ``edges`` (a, b: long) -> (node, root), root = smallest node reachable.

    Self loops, repeated and reversed edges are harmless; rows with a null end
    are ignored.  Nodes without an edge to another node do not appear.
    """
    edges = scratch_table(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = _digest(edges)
    while state[0]:
        # large star: every larger neighbour of u points to the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = (
            both.where(F.col("b") > F.col("a"))
            .join(low, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        # small star: u and its smaller neighbours point to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = (
            large.join(low, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        edges = scratch_table(small)
        now = _digest(edges)
        if now == state:
            break
        state = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
