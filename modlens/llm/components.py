"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every end of the links (a, b): the smallest id reachable; a written table.

    Each round takes the smallest label among the neighbours and then the label of that label, so rounds
    grow with the logarithm of a component's width. Labels are written to the shared folder every round.
    """
    both = written(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v"),
        "links",
    )
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.col("u"), F.min("v")).alias("component")), "labels")
    while True:
        around = (
            both.join(labels.select(F.col("id").alias("v"), "component"), "v")
            .groupBy(F.col("u").alias("id"))
            .agg(F.min("component").alias("near"))
        )
        nearer = labels.join(around, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component")
        )
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = written(
            nearer.join(up, "component", "left").select(
                "id", F.least("component", F.coalesce("top", "component")).alias("component"), "old"
            ),
            "labels",
        )
        drop(links.sparkSession, labels)
        labels = new
        if not new.where("component <> old").limit(1).count():
            drop(links.sparkSession, both)
            found = new.select("id", "component")
            found.scratch_path = new.scratch_path
            return found
