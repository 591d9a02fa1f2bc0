"""Connected components of an undirected link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.scratch import forget, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of links; component is the smallest node that links reach.

    Every round takes the least label of a node's neighbours (a partially aggregated minimum, so a node
    with very many links is no single task's burden) and then the label of that label, which halves
    the remaining distance.  Each round is a written table.  Self-links and repeated links are harmless.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = stored(both.union(both.select("y", "x")).distinct(), "links")
    labels = stored(both.groupBy("x").agg(F.min("y").alias("m")).select(
        F.col("x").alias("node"), F.least("x", "m").alias("component")), "labels")
    last = labels
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), F.col("component").alias("c")), "y")
        near = near.groupBy("x").agg(F.min("c").alias("c"))
        step = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select(
            "node", "component", F.least("component", F.coalesce("c", "component")).alias("next"))
        roots = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        jumped = step.join(roots, "next", "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("new"), "component")
        done = stored(jumped, "labels")
        changed = done.where("new <> component").limit(1).count()
        forget(last)
        last, labels = done, done.select("node", F.col("new").alias("component"))
        if not changed:
            forget(both)
            return labels
