"""Connected components of a table of links, by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """node and label (the smallest node reachable) of every node of links (a, b).

    Each round takes the least label among a node and its neighbours, and then
    follows that label's own label; labels are written to the shared folder
    each round, so lineage stays short.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("lowest"))
        after = stored(lower.join(jump, "low").select("node", F.least("low", "lowest").alias("label"), (F.least("low", "lowest") < F.col("label")).alias("changed")))
        going = not after.where("changed").isEmpty()
        discard(labels)
        labels = after.select("node", "label")
        if not going:
            discard(both)
            return labels
