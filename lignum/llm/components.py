"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lignum.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of ``edges(u, v)``.

    Each round a node takes the smallest label around it, then the label of its
    label, so labels travel in doubling steps.  Minima combine before the shuffle;
    rounds are written to the shared folder.
    """
    both = stored(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
                  .where(F.col("u") != F.col("v")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("component"))
    labels = stored(labels, "labels")
    while True:
        around = (both.join(labels.withColumnRenamed("node", "v"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m")))
        hooked = labels.join(around, "node").select("node", F.col("component").alias("old"),
                                                    F.least("component", "m").alias("c"))
        above = labels.select(F.col("node").alias("c"), F.col("component").alias("up"))
        jumped = stored(hooked.join(above, "c", "left").select(
            "node", "old", F.least("c", F.coalesce("up", "c")).alias("component")), "labels")
        changed = jumped.where(F.col("component") != F.col("old")).limit(1).count()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
