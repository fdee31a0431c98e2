"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label for each end of the links (a, b): label is the least node of its component.

    Labels sink to the least among the neighbours' and then jump to their label's label, so that rounds grow with the
    logarithm of a component's width. Each round is written, which cuts lineage; the driver sees one count.
    """
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = scratch.keep(ends.distinct(), f"{name}-ends")
    labels = scratch.keep(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = ends.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        sunk = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        sunk = scratch.keep(sunk, f"{name}-sunk{turn}")
        ahead = sunk.select(F.col("node").alias("at"), F.col("label").alias("next"))
        jumped = sunk.join(ahead, F.col("label") == F.col("at")).select("node", "was", F.least("label", "next").alias("label"))
        jumped = scratch.keep(jumped, f"{name}-{turn}")
        scratch.drop(f"{name}-sunk{turn}", f"{name}-{turn - 1}")
        labels = jumped.select("node", "label")
        if not jumped.where("label <> was").limit(1).count():
            scratch.drop(f"{name}-ends")
            return labels
