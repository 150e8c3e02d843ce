"""Connected components of a graph of keys by contraction, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize


def _roots(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where a root is its own parent: parents of parents until nothing changes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("__grand"))
        parents = materialize(parents.join(up, "parent").select("node", F.col("__grand").alias("parent"), (F.col("parent") != F.col("__grand")).alias("__moved")))
        if not parents.where("__moved").limit(1).count():
            return parents.select("node", F.col("parent").alias("root"))
        parents = parents.drop("__moved")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    In each round every node takes its smallest neighbour (or itself) as parent, trees of
    parents are contracted to their roots, and the edges between roots remain. A hot node costs one
    row per edge, summed before the shuffle.
    """
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mapping = None
    while True:
        if not edges.limit(1).count():
            break
        smallest = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        own = edges.select(F.col("a").alias("node"), F.col("a").alias("parent"))
        parents = materialize(smallest.unionByName(own).groupBy("node").agg(F.min("parent").alias("parent")))
        roots = _roots(parents)
        if mapping is None:
            mapping = roots
        else:
            mapping = mapping.join(roots.select(F.col("node").alias("root"), F.col("root").alias("__new")), "root", "left").select("node", F.coalesce("__new", "root").alias("root"))
        mapping = materialize(mapping)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("__a"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("__b"))
        moved = edges.join(left, "a").join(right, "b").where("__a != __b")
        edges = materialize(moved.select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct())
    if mapping is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return mapping.select("node", F.col("root").alias("component"))
