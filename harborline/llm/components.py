"""Connected components of a graph of integer nodes, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of edges (u, v). A round shuffles labels and edges only.

    Each round a node takes the smallest label around it, and then the label of its label; chains halve each round.
    """
    both = stage(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u != v").distinct(), "cc-edges")
    labels = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), F.col("component").alias("c")), "v").groupBy("u").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("component", "c").alias("component"), F.col("component").alias("was"))
        step = stage(step, "cc-step")
        hop = step.select(F.col("node").alias("h"), F.col("component").alias("further"))
        step = step.join(hop, step["component"] == hop["h"], "left").select("node", F.least("component", "further").alias("component"), "was")
        labels = stage(step, "cc-labels")
        if not labels.where("component != was").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
