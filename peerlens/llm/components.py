"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_scratch


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root): root is the smallest node reachable from node.

    ``links`` has long columns a and b; direction and repeats do not matter, nulls
    are ignored.  Each round takes the least label of the neighbours (a map-side
    combined minimum, so a node with very many links is no hot task) and then the
    label of that label, which halves the distances.  Rounds go on until nothing
    moves; only the number of moved labels reaches the driver.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = write_scratch(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = write_scratch(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        )
        lower = labels.join(near, "node", "left").select(
            "node", "root", F.least("root", F.coalesce("near", "root")).alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("jumped"))
        moved = write_scratch(
            lower.join(jump, "low", "left").select(
                "node", F.least("low", F.coalesce("jumped", "low")).alias("new"), "root"
            ),
            "labels",
        )
        labels = moved.select("node", F.col("new").alias("root"))
        if moved.where("new <> root").isEmpty():
            return labels
