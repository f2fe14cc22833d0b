"""Connected components of an edge table, by contraction in joins. No component is held in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.common import stored


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; nodes share a root exactly if a path joins them.

    Each round links every node to its smallest neighbour, follows that link once more, and renames
    both ends of every edge; edges inside one new node go. Every node with a smaller neighbour
    vanishes, so rounds are about the logarithm of the longest path. Rows a round are edges and
    nodes, whatever the size of a component, and joins meet two plain exchanges, which adaptive
    execution can split when one node has very many edges. Null ends and loops are ignored.
    """
    edges = stored(
        edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct(), "edges"
    )
    labels = None
    while not edges.isEmpty():
        ends = edges.select("a", "b").union(edges.select("b", "a"))
        smallest = ends.groupBy("a").agg(F.min("b").alias("low"))
        link = stored(smallest.select(F.col("a").alias("node"), F.least("a", "low").alias("to")), "links")
        onward = link.select(F.col("node").alias("to"), F.col("to").alias("root"))
        link = stored(link.join(onward, "to").select("node", "root"), "links")
        if labels is None:
            labels = link
        else:
            renamed = link.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = labels.join(renamed, "root", "left")
            labels = stored(labels.select("node", F.coalesce("next", "root").alias("root")), "labels")
        end_a = link.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        end_b = link.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(end_a, "a").join(end_b, "b").filter("ra <> rb")
        edges = stored(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges"
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
