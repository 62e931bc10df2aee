"""Connected components by propagating the smallest label and jumping to the label's own label.

Every round is joins and one partial aggregation; a hub's edges are split by skew-join handling. Rounds grow with the
logarithm of the longest path. Labels are written each round, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartlens.session import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node that has an edge; label is the smallest node of its component."""
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        sent = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "label")
        least = sent.groupBy("node").agg(F.min("label").alias("offered"))
        nearer = labels.join(least, "node").select("node", F.col("label").alias("old"), F.least("label", "offered").alias("label"))
        nearer = written(nearer, "nearer")
        roots = nearer.select(F.col("node").alias("root"), F.col("label").alias("jump"))
        moved = written(nearer.join(roots, nearer["label"] == roots["root"]).select("node", "old", F.col("jump").alias("label")), "moved")
        labels = moved.select("node", "label")
        if moved.filter(F.col("old") != F.col("label")).limit(1).count() == 0:
            return labels
