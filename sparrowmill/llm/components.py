"""Connected components by least labels and pointer jumping, on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any order and repetition: (node, component) for each node in them, component being the least node.

    Each round a node takes the least label among its neighbours' and its own, then its label's label, so labels spread
    twice as far each round. Rounds end when nothing changes. Minima are aggregated before the shuffle, so a node with
    very many edges is no hot group; labels are written to the checkpoint folder each round.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = runtime.checkpointed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written = runtime.checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(seen, labels.node == seen.a, "left").select("node", F.least("component", "near").alias("next"), F.col("component").alias("old"))
        jumped = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        labels_new = runtime.checkpointed(lower.join(jumped, "next", "left").select("node", F.least("next", "far").alias("component"), "old"))
        changed = labels_new.where("component <> old").limit(1).count()
        runtime.release(written)
        labels, written = labels_new.drop("old"), labels_new
        if not changed:
            runtime.release(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links (a, b) between components, where a node that labels don't have is its own one."""
    top = components(links)
    old = labels.join(top.toDF("component", "_top"), "component", "left").select("node", F.coalesce("_top", "component").alias("component"))
    return old.unionByName(top.join(labels, "node", "left_anti"))
