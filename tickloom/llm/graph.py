"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    In each round a node points to its smallest neighbour if that is smaller than itself; pointers are
    followed to their roots by doubling, edges between different roots are what the next round works
    on. Aggregates combine before they shuffle, so a node with very many edges is no hot key.
    """
    label = None
    while True:
        edges = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up")), "parents")
        while True:
            over = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parent = staged(parent.join(over, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), "parents")
            if parent.where("moved").isEmpty():
                break
            parent = parent.drop("moved")
        parent = parent.select("node", "up")
        if label is None:
            label = parent.select("node", F.col("up").alias("component"))
        else:
            to = parent.select(F.col("node").alias("component"), "up")
            label = staged(label.join(to, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        low = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        high = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(low, "a").join(high, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
