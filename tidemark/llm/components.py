"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``links(a, b)``, for nodes that have a link.

    Each round takes the smallest label of the neighbours and then the label of that label, so long chains
    shrink by half. Labels are written between rounds; the driver only sees how many changed. A node with very
    many links is split by the joins and summed before the shuffle by the grouping.
    """
    spark = links.sparkSession
    both = written(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(spark, both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        better = labels.join(least, "node").select("node", F.least("label", "other").alias("label"), F.col("label").alias("old"))
        hop = better.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(spark, better.join(hop, "label", "left").select("node", F.least("label", "next").alias("label"), "old"))
        labels = after.select("node", "label")
        if after.filter("label <> old").limit(1).count() == 0:
            return labels
