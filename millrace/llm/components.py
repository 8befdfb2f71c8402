"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._spark import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node that it is connected to.

    Each round a node takes the smallest label among its own, its neighbours' and its label's, so labels travel at least
    twice as far each round; rounds grow with the logarithm of the longest path. Every round is written to the shared
    folder. Minima have partial sums, so the centre of a large star is no large group. Edges with a null end and loops are
    left out: a node without another edge has no row.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        known = labels.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        near = both.join(known, F.col("b") == F.col("n2")).groupBy("a").agg(F.min("l2").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next"))
        jump = step.join(known, F.col("next") == F.col("n2")).select("node", F.least("next", "l2").alias("label"), (F.col("label") != F.least("next", "l2")).alias("moved"))
        jump = written(jump, "cc-labels")
        labels = jump.select("node", "label")
        if not jump.where("moved").limit(1).count():
            return labels
