"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyline.sources.scratch import discard, written


def settled(edges: DataFrame) -> bool:
    """Whether every node points to one node, which points nowhere."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    sums = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return sums.filter("out > 1 OR (out = 1 AND into = 1)").isEmpty()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links (a, b), by large-star / small-star.

    A node's links are never gathered: each star step is one minimum per node and one join, which Spark can split
    where a node has many links. The number of rounds grows with the logarithm of the longest chain; they end when all
    links lead from a node to its root. The table of each round replaces that of the round before.
    """
    edges = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()  # a > b in every link
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(small.filter("a <> b").distinct(), "links")
        discard(before)
        if settled(edges):
            break
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
