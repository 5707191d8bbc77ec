"""Connected components whose label is the smallest member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import drop, materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every endpoint of ``edges``, component being the smallest node reachable.

    Each round, a node takes the least label among its neighbours and itself (summed map-side, so a hub is
    one row per task), then the label of that label (pointer jumping), which makes long chains short.
    Labels are written to shared storage each round, so lineage stays short and a lost executor costs no
    more than a reread; the tables of earlier rounds are deleted.
    """
    apart = edges.where(F.col(src) != F.col(dst)).select(F.col(src).alias("v"), F.col(dst).alias("u"))
    both = materialise(apart.unionByName(apart.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "edges")
    table = materialise(both.groupBy("v").agg(F.min("u").alias("u")).select(F.col("v").alias("node"), F.least("v", "u").alias("component")), "labels")
    for _ in range(MAX_ROUNDS):
        labels = table.select("node", "component")
        around = both.join(labels, both.v == labels.node).select("u", "component").groupBy("u").agg(F.min("component").alias("near"))
        own = labels.join(around, F.col("node") == F.col("u"), "left").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        heads = labels.select(F.col("node").alias("h"), F.col("component").alias("hc"))
        jumped = own.join(heads, F.col("component") == F.col("h"), "left").select("node", "old", F.least("component", "hc").alias("component"))
        following = materialise(jumped, "labels")
        moved = not following.where(F.col("old") != F.col("component")).isEmpty()
        drop(table)
        table = following
        if not moved:
            drop(both)
            return table.select("node", "component")
    raise RuntimeError("components did not settle")
