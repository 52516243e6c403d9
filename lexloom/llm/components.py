"""Connected components of a graph held in tables: labels go down to the smallest id by hooking and jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Stages, hot_join

#: Bytes of labels (16 for each node) that may be broadcast; beyond it they are joined by a shuffle that deals hot keys.
BROADCAST_BYTES = 8 << 20


def connected_components(edges: DataFrame, stages: Stages) -> DataFrame:
    """(node, label) for the nodes of `edges` (a, b); label is the smallest node of the component.

    Each round takes the smallest label of the neighbours, hooks it on to the old label as well, and follows labels
    once; all minima are combined before they are shuffled. The rounds end when nothing changes: their number grows
    with the logarithm of the longest chain. Few labels are broadcast, so that only minima are shuffled; else a node
    or label that very many rows have is dealt to several tasks.
    """
    both = stages.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    kept = stages.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label"), F.count("*").alias("n")))
    degrees, labels, first = kept.select(F.col("node").alias("b"), "n"), kept.select("node", "label"), kept  # edges stand in both directions
    few = kept.count() * 16 <= BROADCAST_BYTES

    def joined(rows: DataFrame, single: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
        return rows.join(F.broadcast(single), key, how) if few else hot_join(rows, single, key, how, counts)

    while True:
        near = joined(both, labels.withColumnRenamed("node", "b"), "b", counts=degrees).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        # each node has an edge, so `near` has every node
        seen = near.join(F.broadcast(labels) if few else labels, "node").select("node", "label", F.least("label", "low").alias("low"))
        hooked = seen.groupBy(F.col("label").alias("node")).agg(F.min("low").alias("hook"))
        lower = seen.join(F.broadcast(hooked) if few else hooked, "node", "left").select("node", "label", F.least("low", "hook").alias("low"))
        lower = stages.keep(lower)
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = joined(lower, jump, "low", "left").select("node", F.col("label").alias("old"), F.least("low", "next").alias("label"))
        new = stages.keep(new)
        changed = new.where("label <> old").limit(1).count()
        stages.drop(lower, *([kept] if kept is not first else []))
        kept, labels = new, new.select("node", "label")
        if not changed:
            stages.drop(both, first)
            return labels
