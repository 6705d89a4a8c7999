"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node of its component) for each node of links (a, b).

    Each round gives a node the smallest label among its own and its neighbours', then
    follows that label once (pointer jumping), so that labels travel
    exponentially further; it ends when no label changes.  A round is two
    aggregations and joins, which Spark can split where a hub has many links.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).where("node <> other")
    both = materialise(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("comp")), "labels")
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("comp").alias("near"))
        low = both.join(seen, "other").groupBy("node").agg(F.min("near").alias("near"))
        stepped = labels.join(low, "node").select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        stepped = materialise(stepped, "labels")
        jump = stepped.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        labels = materialise(stepped.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"), "was"), "labels")
        changed = not labels.where("comp <> was").isEmpty()
        labels = labels.select("node", "comp")
        if not changed:
            return labels
