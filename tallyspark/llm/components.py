"""Connected components of an edge table by label propagation with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of one orderable type -> ``(node, label)``, label the smallest node reachable.

    Each round lowers a node's label to the smallest among its neighbours' labels
    and then to its label's own label, so chains shrink geometrically. Every round
    is two hash joins and a pre-aggregated minimum; nothing but a count reaches
    the driver. An empty edge table gives an empty result.
    """
    both = materialise(
        edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges"
    )
    labels = materialise(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "v"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        lower = materialise(
            labels.join(near, "node", "left").select(
                "node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label")
            ),
            "lower",
        )
        up = lower.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = materialise(
            lower.join(up, "label", "left").select(
                "node", "was", F.least("label", F.coalesce("up", "label")).alias("label")
            ),
            "labels",
        )
        forget(labels)
        forget(lower)
        labels = after
        if after.filter("label <> was").isEmpty():
            return labels.select("node", "label")
