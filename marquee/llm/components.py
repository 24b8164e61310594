"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.scratch import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node that has a link; the root is the component's smallest node.

    Rounds of two steps. First every node's larger neighbours are pointed to its smallest
    neighbour, or to itself if that is smaller; then its smaller neighbours are. The links
    thus become stars around the roots in a number of rounds that grows with the logarithm
    of the component's size, and a node with many links sends one row for each of them and
    no pairs of neighbours. Each round is a written table.
    """
    edges = written(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        large = large.distinct()
        lower = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(lower, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x > y")
        edges = written(small.unionAll(lower.select("x", F.col("m").alias("y"))).distinct())
        # Unchanged links are stars already. Two sums over different hashes tell.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y") % 1000003), F.sum(F.xxhash64("y", "x", F.lit(1)) % 998244353)).first()
        if state == before:
            return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).unionAll(
                edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
            )
        before = state
