"""Connected components of links between nodes, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sightline.operators.ordering import salted_join
from sightline.session import cut_lineage, release


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node in ``links`` (a, b).

    Runs one written table per round; the number of rounds grows with the logarithm of the longest path.
    Hub nodes are combined before the shuffle and salted in the joins.  Labels are repeated per salt and their
    files are packed, so they are many times larger than Catalyst thinks and are never offered for a broadcast.
    """
    both = cut_lineage(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        seen = salted_join(both.hint("merge"), labels.withColumnRenamed("node", "b"), ["b"], ["a"]).select(
            F.col("a").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        nearest = seen.union(own).groupBy("node").agg(F.min("label").alias("near"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("next"))
        moved = cut_lineage(
            salted_join(nearest.hint("merge"), jump, ["near"], ["node"]).select("node", F.least("near", "next").alias("label"), "old"))
        release(labels)
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            release(both)
            return labels
