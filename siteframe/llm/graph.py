"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteframe.core import cut_lineage


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node of its component.

    In each round a node points at its smallest neighbour, if that is smaller, and then at what this one points at. Nodes
    that point at the same one are merged, and only edges between different ones go on, once each. A
    node that keeps its place has neighbours that leave theirs, so that the graph shrinks fast and the rounds are few.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = cut_lineage(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")))
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        first = cut_lineage(first)
        jump = first.join(first.select(F.col("node").alias("to"), F.col("to").alias("over")), "to").select("node", F.col("over").alias("to"))
        jump = cut_lineage(jump, first)
        at = lambda name: jump.select(F.col("node").alias(name), F.col("to").alias(f"{name}_to"))
        moved = edges.join(at("a"), "a").join(at("b"), "b").filter("a_to <> b_to").select(
            F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct()
        edges = cut_lineage(moved, edges)
        roots = cut_lineage(roots.join(at("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")), roots)
    return roots
