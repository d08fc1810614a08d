"""Connected components of a link table, by label propagation with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node in ``links`` (a long, b long); the label is the smallest node reachable.

    Each round takes the least label among a node and its neighbours and then
    follows the label's own label, so chains shrink by halves; every round is
    written to the shared folder.  Nothing but a count reaches the driver.
    """
    both = scratch.save(
        links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))).where("node <> near").distinct(), "edges"
    )
    labels = scratch.save(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = scratch.save(step.join(up, "label", "left").select("node", "old", F.least("label", F.coalesce("up", "label")).alias("label")), "labels")
        scratch.drop(labels)
        labels = step.select("node", "label")
        labels._scratch_path = step._scratch_path
        if not step.where("label <> old").limit(1).count():
            return labels
