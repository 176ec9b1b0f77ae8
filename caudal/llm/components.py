"""Connected components of an edge table, as joins and aggregates only.

Large-star / small-star rounds: each round links the neighbours of a node to
the smallest of them, until every component is a star around its smallest
node. Rounds grow with the logarithm of the longest path, nothing is
collected, and each round is cut by a checkpoint in the session's folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.session import shared_dir


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _star(pairs: DataFrame) -> DataFrame:
    """(a, b, m): each pair with the smallest of ``a`` and its partners."""
    low = pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return pairs.join(low, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Loops and repeated edges are allowed; an empty table gives an empty table.
    """
    shared_dir(edges.sparkSession)
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = edges.checkpoint()
    before = None
    while (now := _state(edges)) != before and now[0]:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        linked = _star(large)
        small = (linked.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(linked.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        edges = small.checkpoint()
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
