"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.shared import written


def _stars(edges: DataFrame) -> DataFrame:
    """Point every neighbour of a node, and the node itself, at the least node around it (both kinds of step at once).

    The edges of a node that is the least around it are left out: each of its neighbours names it, or a lesser one and it
    along, so a star's centre, which may have the edges of a third of all nodes, meets no more than its own row.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # a stored table, so that the join below is of plain scans, whose hot keys Spark can split
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "least-around")
    moved = both.join(least, "a").select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    return moved.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links``: (a, b). Returns (set_key, component) for every node of a link; component is its least node.

    Each round replaces the edges by edges to the least node in reach; the edges stay as many as
    the nodes or fewer than before, and the number of rounds grows with the logarithm of the paths.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        # a star of least nodes is the one edge table that a step leaves as it is
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen, edges = state, written(_stars(edges), "links")
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("set_key"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("set_key"), F.col("b").alias("component")).distinct())
