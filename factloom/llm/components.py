"""Connected components of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.lineage import cut
from factloom.skew import by_shuffle, skew_join


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reached) of every node with a link.

    Labels spread to neighbours and are then followed to the label of the label,
    so the rounds grow with the logarithm of the longest path.  Links are
    undirected; null ends, repeated links and loops do not matter; no links give
    an empty result.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")))
    while True:
        heard = skew_join(edges, by_shuffle(labels.select(F.col("node").alias("v"), "component")), ["v"], F.col("u"))
        spread = (
            heard.select(F.col("u").alias("node"), "component").unionByName(labels)
            .groupBy("node").agg(F.min("component").alias("component"))
        )
        far = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = skew_join(spread, by_shuffle(far), ["component"], F.col("node"), "left").select(
            "node", F.coalesce(F.least("component", "further"), F.col("component")).alias("component")
        )
        before, labels = labels, cut(jumped)
        changed = labels.join(by_shuffle(before.withColumnRenamed("component", "old")), "node").where("component <> old")
        if changed.isEmpty():
            return labels
