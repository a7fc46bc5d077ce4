"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.session import materialize


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) for the nodes of ``links`` (a, b).

    Each round every node takes the smallest label around it and then that label's label, so that
    chains halve; it ends when no label changes. Labels are aggregated by node, never gathered.
    """
    edges = links.select("a", "b").union(links.select("b", "a")).toDF("a", "b").filter("a <> b").distinct()
    edges = materialize(edges, "edges")
    label = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("near"))
        # The label's own label, and the smallest label that any node of this label sees.
        seen = label.join(around.withColumnRenamed("a", "node"), "node").select("node", "component", F.least("component", "near").alias("low"))
        roots = seen.groupBy("component").agg(F.min("low").alias("root"))
        next_ = materialize(seen.join(roots, "component").select("node", F.col("component").alias("old"), F.least("low", "root").alias("component")), "labels")
        if next_.filter("old <> component").isEmpty():
            return next_.select("node", "component")
        label = next_.select("node", "component")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` (node, component) after further ``links`` (a, b): only components that they touch are worked on."""
    side = {c: label.select(F.col("node").alias(c), F.col("component").alias(f"{c}_of")) for c in "ab"}
    known = links.join(side["a"], "a", "left").join(side["b"], "b", "left")
    over = components(known.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    fresh = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(label, "node", "left_anti")
    nodes = label.unionByName(fresh.select("node", F.col("node").alias("component")))
    over = over.select(F.col("node").alias("component"), F.col("component").alias("final"))
    return materialize(nodes.join(over, "component", "left").select("node", F.coalesce("final", "component").alias("component")), "labels")
