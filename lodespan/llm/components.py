"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespan.session import cut


def stars(edges: DataFrame) -> DataFrame:
    """From edges (a long, b long), in any direction, repeated or not: one row (node, root) for each node that isn't its
    component's smallest, with the component's smallest node as root. Loops (a = b) count for nothing.

    Every step writes its edges to the shared folder. A step's joins bring each edge together with the smallest
    neighbour of one end; a node with very many neighbours makes a skewed join, which adaptive execution splits.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = cut(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        # Large star: every larger neighbour points to the smallest.
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a node and its smaller neighbours point to the smallest of these.
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct(), "edges")
