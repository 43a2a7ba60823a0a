"""Connected components of a distributed edge list by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, is_small, matched, stored


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """For edges (a, b) of longs: (node, comp), comp being the smallest node that is reachable.

    Every round a node takes the smallest label among its neighbours and then its
    label's label. Rounds are stored tables, so lineage stays short; only the
    number of changed labels comes to the driver. Neither a node with a large
    share of the edges nor a label that many nodes have puts them in one task.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "cc-labels")
    small = is_small(labels)  # every round has as many
    for _ in range(max_rounds):
        near = matched(both, labels.withColumnRenamed("node", "b"), "b", "a", small).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        after = stored(matched(lower, jump, "comp", "node", small).select("node", "old", F.least("comp", "next").alias("comp")), "cc-labels")
        changed = after.where("old <> comp").limit(1).count()
        dropped(labels)
        labels = after.select("node", "comp")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
