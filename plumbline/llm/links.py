"""Connected components of links, by contraction: every round all nodes move to their first neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (node, root) for every node with a link; equal roots mean connected.

    A round draws a new order of all nodes by hash, sends every node to the first of itself and its neighbours, and
    keeps the links between different targets. Nodes shrink by a constant factor a round in expectation, whatever
    the shape of the graph. Each round is written, so neither plans nor recovery grow with the rounds. First
    neighbours are found by an aggregate with map-side combine; a hub's links never meet in one task.
    """
    edges = kept(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        order = lambda node, turn=turn: F.xxhash64(node, F.lit(turn))
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("key"), "b")).alias("first"))
        moved = kept(first.select(F.col("a").alias("node"), F.when(
            order(F.col("a")) <= F.col("first.key"), F.col("a")).otherwise(F.col("first.b")).alias("root")), "moves")
        if roots is None:
            roots = moved
        else:
            then = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = kept(roots.join(then, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = kept(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots
