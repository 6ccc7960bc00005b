"""Connected components of an edge table by label propagation with pointer jumping, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``: label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then the label of that label. What a node's
    neighbours say combines before it shuffles; the edges of a node with very many meet its one label in a join, which Spark splits.
    Edges with a null end are ignored.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = both.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), F.least("a", "label").alias("label"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("further"))
        new = new.join(jump, "to").select("node", F.col("label").alias("old"), F.least("to", "further").alias("label"))
        new = written(new, "labels")
        removed(labels)
        done = new.where("old <> label").isEmpty()
        labels = new.drop("old")
        labels.written_at = new.written_at
        if done:
            removed(both)
            return labels
