"""Connected components of an undirected graph given by edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import kept


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of every end of ``edges`` (a, b): label is the smallest id of its component.

    Each round takes the least label among the neighbours and then the label of that label, and is written out;
    rounds end when no label changes. Nothing is collected but the number of changes."""
    pairs = kept(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    low = pairs.groupBy("b").agg(F.min("a").alias("low"))  # an id keeps its least neighbour, which takes over the others
    moved = pairs.join(low, "b").where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b")).distinct()
    fewer = moved.unionByName(low.select(F.col("low").alias("a"), "b"))
    both = kept(fewer.unionByName(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("was"), F.least("label", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        labels = kept(low.join(up, "low").select("id", F.least("low", "up").alias("label"), "was"), "labels")
        if not labels.where("label != was").limit(1).count():
            return labels.select("id", "label")
