"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.storage import stored


def components(links: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex each vertex of ``links`` (a, b) is connected with.

    Every round takes the smallest label among a vertex and its neighbours, then the label of that
    label, so rounds grow with the logarithm of the longest path. Each round is written to the
    shared folder; only whether anything changed comes back.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        lower = stored(
            labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c")), "labels"
        )
        jump = lower.select(F.col("v").alias("c"), F.col("c").alias("next"))
        labels = stored(lower.join(jump, "c").select("v", "old", F.least("c", "next").alias("c")), "labels")
        if labels.where("c <> old").isEmpty():
            return labels.select("v", "c")
        labels = labels.select("v", "c")
