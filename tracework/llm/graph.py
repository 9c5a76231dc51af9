"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node that can be reached) for the nodes of ``links(a, b)``.

    Labels spread to neighbours and then jump to their label's label, so long chains shrink fast;
    each round is written to the shared folder, and rounds end when no label changes.
    """
    edges = links.where("a is not null and b is not null and a <> b").select("a", "b")
    edges = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    labels = keep(labels.select("node", F.least("node", "component").alias("component")), "labels")
    while True:
        around = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("around"))
        )
        new = labels.join(around, "node").select("node", F.least("component", "around").alias("label"), "component")
        # jump: the label of the label, as it was before this round
        known = labels.select(F.col("node").alias("label"), F.col("component").alias("beyond"))
        new = new.join(known, "label").select("node", F.least("label", "beyond").alias("label"), "component")
        new = keep(new, "labels")
        changed = new.where("label <> component").limit(1).count()
        labels = new.select("node", F.col("label").alias("component"))
        if not changed:
            return labels
