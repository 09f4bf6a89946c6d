"""Connected components by alternating large-star and small-star contraction.

Each round costs two aggregates and two joins over the edges left. Every aggregate combines before its
shuffle, and joins are sort-merge joins of two tables, each behind an exchange of its own, in which adaptive execution
splits a hub's partition: a star of any size is spread over tasks. Edges stay in tables, of which those of a round go with the
next; only a count and a checksum reach the driver.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.work import discard, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u long, v long) -> (node, root), a written table: root is the smallest node reachable, for nodes in an edge.

    Self-loops, repeated edges and edges with a null end are ignored; no edges give no rows. Contraction ends after a number of
    rounds that grows with the logarithm of the longest path, squared at most; `rounds` only guards against a fault.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, seen = written(e, "edges"), None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            roots = written(e.selectExpr("u as node", "v as root").union(e.select("v", "v")).distinct(), "roots")
            discard(e)
            return roots
        before, seen = e, now
        large = written(before.select("u", "v").union(before.select("v", "u")).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        e = _large_star(before, large)
        small = written(e.groupBy("u").agg(F.min("v").alias("m")), "least")
        e = written(_small_star(e, small).distinct(), "edges")
        discard(before, large, small)
    raise RuntimeError(f"no fixed point after {rounds} rounds")


def _large_star(e: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of its neighbourhood."""
    both = e.select("u", "v").union(e.select("v", "u"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(e: DataFrame, least: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    moved = e.join(least.hint("merge"), "u").selectExpr("v as u", "m as v")
    return moved.union(least.selectExpr("u", "m as v")).where("u <> v")
