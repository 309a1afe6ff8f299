"""Connected components of a link table, by contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compactcodec.llm.common import materialise


def connected_components(links: DataFrame) -> DataFrame:
    """(v, component) for every id in ``links`` (a, b); the component is the smallest id reachable.

    Each round points every id at its smallest neighbour, or itself, and follows the pointers once
    more; then links are rewritten to the pointers' ends and those within one end vanish.  Every id
    with a link joins another in each round or is joined, so the number of rounds grows with the
    logarithm of the number of ids.  Names only get smaller, so the last one is the smallest id.  The
    links of an id are reduced before the shuffle; none are collected.
    """
    links = materialise(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while links.limit(1).count():
        both = links.select(F.col("a").alias("v"), F.col("b").alias("to")).union(links.select(F.col("b").alias("v"), F.col("a").alias("to")))
        near = materialise(both.groupBy("v").agg(F.least(F.col("v"), F.min("to")).alias("to")), "pointers")
        again = near.select(F.col("v").alias("to"), F.col("to").alias("next"))
        point = materialise(near.join(again, "to").select("v", F.col("next").alias("to")), "pointers")
        if labels is None:
            labels = point.withColumnRenamed("to", "component")
        else:
            step = point.select(F.col("v").alias("component"), "to")
            labels = materialise(labels.join(step, "component", "left").select("v", F.coalesce("to", "component").alias("component")), "labels")
        left = point.select(F.col("v").alias("a"), F.col("to").alias("x"))
        right = point.select(F.col("v").alias("b"), F.col("to").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links = materialise(moved, "links")
    return labels if labels is not None else links.select(F.col("a").alias("v"), F.col("a").alias("component"))
