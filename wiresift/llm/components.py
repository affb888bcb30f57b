"""Connected components by least label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a, b); component is the least node of each.

    Each round takes the least label among neighbours, then the label of that
    label, and is written to the shared folder.  Hubs are safe: minima are
    formed in the map tasks before the shuffle.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = shared.written(both.distinct())
    labels = shared.written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    last = labels
    while True:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"], "left")
        step = step.select("node", F.least("component", F.coalesce("near", "component")).alias("next"), "component")
        target = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        step = step.join(target, "next", "left").select(
            "node", F.least("next", F.coalesce("further", "next")).alias("component"), F.col("component").alias("before")
        )
        step = shared.written(step)
        shared.discard(last)
        labels, last = step.select("node", "component"), step
        if step.where(F.col("component") != F.col("before")).isEmpty():
            shared.discard(both)
            return labels
