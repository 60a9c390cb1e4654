"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brieflane.llm.common import saved


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge; the label is the component's smallest node.

    Each round points every node to its smallest neighbour, halves the pointers' paths, and
    contracts the edges to the labels; edges within a label vanish. Only tables of the size of
    what is left are shuffled, and each round's tables are checkpointed.
    """
    left = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        up = saved(up.select(F.col("a").alias("node"), "to"))
        up2 = up.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        up = saved(up.join(up2, "to").select("node", F.col("to2").alias("to")))
        step = up.select(F.col("node").alias("label"), F.col("to"))
        if labels is None:
            labels = up.select("node", F.col("to").alias("label"))
        else:
            labels = labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = saved(labels)
        ends = left.join(up.select(F.col("node").alias("a"), F.col("to").alias("la")), "a") \
            .join(up.select(F.col("node").alias("b"), F.col("to").alias("lb")), "b")
        left = saved(ends.where(F.col("la") != F.col("lb")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
