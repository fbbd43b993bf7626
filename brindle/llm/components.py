"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.scratch import Scratch


def components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """(u, v) of numbers -> (node, label): the least node reachable from each node with an edge.

    Each round a node takes the least label among itself, its neighbours and the label of its
    label; minima are summed up before each shuffle, so a hub costs one row per task. Every round
    is a table of ``keep``. No edges give an empty table; loops are ignored.
    """
    both = keep(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "cc-edges")
    labels = keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("u"), "label"), "u").select(F.col("v").alias("node"), "label")
        up = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("l2")), "label").select("node", F.col("l2").alias("label"))
        # the old label rides along, so that a change shows without another join
        known = labels.select("node", "label", F.col("label").alias("old"))
        least = known.unionByName(near.union(up), allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        # a star's centre pulls its leaves' labels in: hook the old label to the new one as well
        hooked = least.where("label < old").select(F.col("old").alias("node"), "label")
        new = keep(least.unionByName(hooked, allowMissingColumns=True).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")), "cc-labels")
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
