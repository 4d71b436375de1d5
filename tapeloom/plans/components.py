"""Connected components of a two-sided edge table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import settle


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(left, label): label is the smallest left key reachable. Stops when no label changes.

    Each round is two partial-aggregated minima over the edges and one jump along the labels, so long chains shrink
    geometrically; labels are settled each round, which keeps the plan flat and survives lost executors.
    """
    edges = settle(edges.select(left, right).distinct())
    labels = edges.select(left, F.col(left).alias("label")).distinct()
    while True:
        near = edges.join(labels, left).groupBy(right).agg(F.min("label").alias("_m"))
        best = edges.join(near, right).groupBy(left).agg(F.min("_m").alias("_m"))
        jump = labels.select(F.col(left).alias("_m"), F.col("label").alias("_j"))
        old = labels.withColumnRenamed("label", "_old")
        step = settle(best.join(jump, "_m", "left").join(old, left)
                      .select(left, F.least("_m", F.coalesce("_j", "_m")).alias("label"),
                              (F.least("_m", F.coalesce("_j", "_m")) != F.col("_old")).alias("_changed")))
        labels = step.drop("_changed")
        if step.filter("_changed").isEmpty():
            return labels
