"""Connected components of an edge table, with DataFrame joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import settle


def _only_stars(edges: DataFrame) -> bool:
    """Every greater node (a) has one lesser neighbour (b), which is no node's greater one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e"))
    ends = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    return not ends.where("up > 1 or (up = 1 and n > 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of an edge (a, b); root is the least node of the component.

    Alternates large-star and small-star steps: each links a node's larger (then its smaller) neighbours to its least
    neighbour, until only stars are left. Sums of neighbours are formed before the exchange, so a hub is no one task's work.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _only_stars(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = settle(small)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
