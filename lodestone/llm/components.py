"""Connected components of a graph given as an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_values, join_split, materialize_merged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of the edges (a, b), labelled with the least node that it is connected to.

    In each round a node takes the least label among its neighbours' and its own, and then the label of that label; rounds grow with the logarithm of a
    chain's length. Nodes without edges do not appear. Null nodes are left out. Self-links and repeated edges do no harm.
    """
    edges = edges.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a is not null and b is not null")
    both = materialize_merged(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()).withColumnRenamed("b", "node")
    labels = materialize_merged(both.groupBy("a").agg(F.least(F.min("node"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    hubs = hot_values(both, "node")
    while True:
        # The edges of hubs, and nodes that share a label with many, meet broadcasts of few rows; sums are combined before they are shuffled.
        near = join_split(both, labels, "node", hubs, False).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "node")
        one = materialize_merged(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next")))
        new = materialize_merged(join_split(one, labels.select(F.col("node").alias("next"), F.col("label").alias("jump")), "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("label")).alias("changed")))
        changed = new.filter("changed").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
