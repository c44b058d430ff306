"""Connected components of a table of links, in rounds of joins; no link or label goes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the links (a, b) with the smallest node it reaches.

    Each round, a node steps to the smallest of itself and its neighbours, and the links are redrawn between the nodes
    stepped to, until none joins two nodes. Rounds grow with the logarithm of a component's width; each is written to
    the shared folder, so a lost executor costs one round. Links with a null end and links from a node to itself add no
    node to another.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "step")
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            moved = labels.join(step, labels["component"] == step["node"], "left")
            labels = moved.select(labels["node"], F.coalesce("to", "component").alias("component"))
        labels = written(labels, "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        edges = written(ends.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return labels
