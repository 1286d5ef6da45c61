"""Connected components of a link table by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import cut


def connected_components(links: DataFrame) -> DataFrame:
    """(v, root) for every end of a link (a, b), root being the smallest vertex it is connected with.

    Each round takes the least label among neighbours (a partially aggregated minimum, so a hub costs its reducer one
    row per map task) and then jumps to the label's label. Rounds are cut by checkpoints; they end when nothing changes.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("v"), "root"))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("root").alias("near"))
        lower = labels.join(near, labels.v == near.a).select("v", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("v").alias("up"), F.col("root").alias("up_root"))
        new = cut(lower.join(up, lower.root == up.up).select("v", "was", F.least("root", "up_root").alias("root")))
        changed = new.filter("root <> was").limit(1).count()
        labels = new.select("v", "root")
        if not changed:
            return labels
