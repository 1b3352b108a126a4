"""Connected components of an edge list, for the near-duplicate operator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slate.session import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that can be reached.

    ``edges`` has columns a and b with values of one ordered type. A round hooks every node to the smallest of itself and its
    neighbours, follows the pointers to their ends, and goes on with the edges between different ends until there are
    none. A node that is not the smallest among its neighbours is gone after its round, so every round ends with fewer nodes, and a
    path has half as many at most, whatever its labels are. There is no bound of rounds. Each one is written to the shared
    folder. Minima are taken before the shuffle, so a node with very many edges costs no more than the others.
    """
    near = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    whole = None
    while True:
        both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _ends(cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root"))))
        if whole is None:
            whole = ends
        else:
            above = ends.select(F.col("node").alias("root"), F.col("root").alias("top"))
            whole = whole.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        tops = [ends.select(F.col("node").alias(c), F.col("root").alias(f"{c}_top")) for c in ("a", "b")]
        moved = near.join(tops[0], "a").join(tops[1], "b").where("a_top <> b_top")
        left = cut(moved.select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct())
        discard(near)
        near = left
        if near.isEmpty():
            return whole


def _ends(pointers: DataFrame) -> DataFrame:
    """(node, root) with every pointer followed to its end, a node that points to itself. Steps grow with the logarithm of the longest way."""
    while True:
        above = pointers.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = cut(pointers.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        done = jumped.where("moved").isEmpty()
        discard(pointers)
        pointers = jumped.select("node", "root")
        if done:
            return pointers
