"""Connected components by the smallest label, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmill.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (v, c): c is the smallest node that v can reach.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, so rounds grow with the logarithm of the longest path. Labels are written after each
    round; only whether any changed comes to the driver.
    """
    both = written(
        edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(
            edges.select(F.col("b").alias("v"), F.col("a").alias("w"))
        ).distinct(),
        "edges"
    )
    labels = written(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("w"), F.col("c").alias("m")), "w").groupBy("v").agg(F.min("m").alias("m"))
        lower = written(labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old")), "labels")
        jump = lower.select(F.col("v").alias("c"), F.col("c").alias("j"))
        after = written(lower.join(jump, "c").select("v", F.least("c", "j").alias("c"), "old"), "labels")
        if after.where("c != old").isEmpty():
            return after.select("v", "c")
        labels = after.select("v", "c")
