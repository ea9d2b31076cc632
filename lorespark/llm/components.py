"""Connected components of a graph given as an edge table: each node's component is its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm import common


def _ends(pointers: DataFrame, name: str, rows: int) -> DataFrame:
    """node, top: where pointers (node, top), of no more than rows, end, followed by doubling: a path of n takes log n rounds."""
    while True:
        up = pointers.select(F.col("node").alias("top"), F.col("top").alias("_next"))
        further = common.materialize(pointers.select("node", "top").join(up, "top").select("node", F.col("_next").alias("top"), (F.col("_next") != F.col("top")).alias("moved")), f"{name}-tops", rows)
        common.release(pointers)
        if further.where("moved").isEmpty():
            return further
        pointers = further


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, label for every node of edges (a, b: long).

    In each round every node points to its smallest neighbour, or to itself if it is smaller; pointers are followed to
    their ends, edges are drawn between these, and those within one node vanish. Pointers only descend, so no cycle arises,
    and ends are smaller than all of their neighbours, so each round leaves at most half of the nodes. Nothing comes to the
    driver but whether edges and pointers are left.
    """
    between = common.materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), f"{name}-edges")
    labels, left = None, between.count()
    nodes = 2 * left
    while labels is None or left:
        ends = between.select(F.col("a").alias("node"), F.col("b").alias("near")).union(between.select("b", "a"))
        tops = _ends(common.materialize(ends.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("top")), f"{name}-parents", 2 * left), name, 2 * left)
        last, to = labels, tops.select("node", "top")
        if labels is None:
            labels = to.withColumnRenamed("top", "label")
        else:
            labels = labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("top", "label").alias("label"))
        labels = common.materialize(labels, f"{name}-labels", nodes)
        first = between.join(to.select(F.col("node").alias("a"), F.col("top").alias("ta")), "a")
        drawn = first.join(to.select(F.col("node").alias("b"), F.col("top").alias("tb")), "b")
        drawn = common.materialize(drawn.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where(F.col("a") != F.col("b")).distinct(), f"{name}-edges", left)
        common.release(between, tops, last)  # nothing reads a round's tables any more
        between, left = drawn, drawn.count()
    common.release(between)
    return labels
