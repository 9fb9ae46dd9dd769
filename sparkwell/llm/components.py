"""Connected components by joins: the smallest neighbour's label, then label jumping, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.llm.stash import cut


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, label): every node of a link with the smallest node reachable from it.

    Nulls and self links are ignored; an empty input gives an empty result. Rounds grow with the logarithm of a
    component's diameter; hubs are pre-aggregated before each shuffle and joins are left to AQE to split.
    """
    one = links.where("a <> b").select("a", "b").distinct()
    both = cut(one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "node", "left").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        step = cut(nearer.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if step.where("moved").isEmpty():
            return labels
