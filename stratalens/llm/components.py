"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.session import materialize


def settled(steps: DataFrame) -> DataFrame:
    """(node, root) from ``steps`` (node, root) that lead from node to node without a cycle: where each one ends.

    A step is joined with the step that follows it, so the steps double in length each round.
    """
    steps = materialize(steps.select("node", "root"))
    while True:
        ahead = steps.select(F.col("node").alias("root"), F.col("root").alias("further"))
        moved = materialize(steps.join(ahead, "root", "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        steps = moved.select("node", "root")
        if moved.where("moved").isEmpty():
            return steps


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for the ends of ``edges`` (a, b): root is the smallest node that links lead to.

    Every round each node takes its smallest neighbour, if that is smaller; these steps are followed to their ends, and
    the graph shrinks to the ends, with the links between different ones. A node that has no smaller neighbour takes others in, or has a
    smaller one in the next round, since its neighbours went to smaller ones. So two rounds halve the nodes at least,
    whatever the length of a chain, and rounds go on until no link is left. Every round is stored, which cuts the
    lineage. A null end links nothing; an empty table gives no rows.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = materialize(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        # ``a`` is the smaller end, so only the larger one can step.
        ends = settled(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
        labels = materialize(_moved(labels, "root", ends))
        shrunk = _moved(_moved(edges, "a", ends), "b", ends).where("a <> b")
        edges = materialize(shrunk.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return labels


def _moved(rows: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """``rows`` with the end of the steps from ``column`` in its place."""
    to = ends.select(F.col("node").alias(column), F.col("root").alias("to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("to", column)).select(*rows.columns)
