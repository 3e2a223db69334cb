"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import dropped, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the smallest node that it reaches.

    Each round takes the least label among neighbours and then the label of the label, so that paths
    halve; rounds grow with the logarithm of the longest path. Labels are written in each round, and those
    of the round before deleted.
    """
    edges = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("label").alias("low"))
        step = labels.join(near, F.col("node") == F.col("at")).select("node", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        step = materialize(step)
        jump = step.select(F.col("node").alias("to"), F.col("label").alias("next"))
        found = materialize(step.join(jump, F.col("label") == F.col("to")).select("node", F.least("label", "next").alias("label"), "old"))
        done = found.filter(F.col("label") != F.col("old")).isEmpty()
        dropped(labels, step)
        if done:
            dropped(edges)
            return found.select("node", F.col("label").alias("component"))
        labels = found.drop("old")
