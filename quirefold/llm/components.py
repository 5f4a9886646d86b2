"""Connected components of a table of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """Per vertex of ``links(a, b)``: v, label (the smallest vertex of its component).

    Every round a vertex takes the smallest label among its own and its
    neighbours', then the label of that label, so the distance to the smallest
    vertex halves.  Both steps are aggregates with map-side combining; a vertex
    with very many links is no hot group.  Rounds end when no label changes.
    """
    both = durable(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("label")).select("v", F.least("v", "label").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.v == near.a).select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("v").alias("at"), F.col("label").alias("far"))
        new = durable(step.join(jump, step.label == jump.at, "left").select("v", F.coalesce(F.least("label", "far"), "label").alias("label"), "old"))
        labels = new.select("v", "label")
        if new.where("label <> old").isEmpty():
            return labels
