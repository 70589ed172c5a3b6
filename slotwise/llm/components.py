"""Connected components of a large edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotwise.llm.shelf import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root): root is the smallest node reachable, for every node of ``edges`` (a, b).

    Each round gives every node its smallest neighbour as parent, follows parents twice, and maps the edges to
    the parents; edges inside a component vanish, so rounds shrink geometrically. A node with many neighbours
    is one aggregate row (partial minimum before the shuffle). Nulls and loops are ignored; no edges give no rows.
    """
    left = shelf.put(edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            left.select(F.col("b").alias("node"), F.col("a").alias("other")))
        parent = shelf.put(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("parent")))
        parent = shelf.put(_follow(_follow(parent, parent), parent))
        if roots is None:
            roots = parent.withColumnRenamed("parent", "root")
        else:
            up = parent.select(F.col("node").alias("root"), F.col("parent").alias("higher"))
            roots = shelf.put(roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        to_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        to_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = shelf.put(
            left.join(to_a, "a").join(to_b, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def _follow(labels: DataFrame, parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
    return labels.join(up, "parent", "left").select("node", F.coalesce("higher", "parent").alias("parent"))
