"""Connected components by least labels with pointer jumping; every round is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of `links` (a, b): root is the least node it reaches.

    Labels take the least label among neighbours and then their label's own label, which halves chains, until nothing
    changes. Nothing is collected but the number of changes.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges = stored(both, "links")
    labels = stored(edges.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("lower"))
        of = labels.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
        moved = lower.join(of, lower["lower"] == of["_node"], "left").select("node", F.least("lower", F.coalesce("_root", "lower")).alias("root"), F.col("root").alias("was"))
        done = stored(moved, "labels")
        labels = done.select("node", "root")
        if done.where("root <> was").isEmpty():
            return labels
