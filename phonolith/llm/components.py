"""Connected components by minimum labels, with written tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolith.llm.common import Scratch, broadcast_if_small


def components(scratch: Scratch, edges: DataFrame, name: str, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of edges(a, b): the smallest node it reaches.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so long chains
    shorten by halves; per-node minima are combined before the shuffle, so a hub with any number of edges is one row
    per map task. Labels are counted: up to the broadcast bound a round shuffles once, beyond it Spark joins by shuffle.
    """
    both = scratch.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-both")
    labels = scratch.keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), f"{name}-0")
    n = labels.count()
    for i in range(1, most_rounds + 1):
        of = lambda node, root: broadcast_if_small(labels.select(F.col("node").alias(node), F.col("root").alias(root)), n)  # noqa: B023, E731
        near = both.join(of("b", "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = near.join(of("node", "root"), "node").select("node", "root", F.least("root", "near").alias("new"))
        low = F.least("new", F.coalesce("far", "new"))
        new = step.join(of("new", "far"), "new", "left").select("node", low.alias("root"), (low < F.col("root")).alias("changed"))
        kept = scratch.keep(new, f"{name}-{i}")
        labels = kept.select("node", "root")
        if kept.where("changed").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
