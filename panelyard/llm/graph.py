"""Connected components as joins and minimum aggregates, with lineage cut after each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.text import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the component is its smallest node.

    Each step hands the smallest known label over every edge, then replaces labels by their labels' labels, so paths
    shrink by half at least; a node of any degree only meets minimum aggregates and joins that can be split.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")))
    while True:
        heard = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("heard"))
        low = labels.join(heard, labels.node == heard.a).select("node", F.col("component").alias("old"), F.least("component", "heard").alias("component"))
        next_of = low.select(F.col("node").alias("component"), F.col("component").alias("further"))
        jumped = cut(low.join(next_of, "component").select("node", "old", F.least("component", "further").alias("component")))
        labels = jumped.select("node", "component")
        if jumped.where("old != component").isEmpty():
            return labels


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after joining the components that further edges (a, b) link. labels: one row a node; nodes of
    edges without a row are components of their own."""
    of_a = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    of_b = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    lifted = edges.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
    joined = components(lifted).select(F.col("node").alias("component"), F.col("component").alias("joined"))
    known = labels.join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    new = joined.select(F.col("component").alias("node"), F.col("joined").alias("component")).join(labels.select("node"), "node", "left_anti")
    return cut(known.union(new))
