"""Connected components of an edge table, without gathering anything on the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecforge.llm.common import Scratch, hot_keys


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, label) of every node of ``edges`` (u, v longs); label is the component's smallest node.

    Each round takes the smallest label among a node's neighbours and then the label of its label, which
    halves long chains. Neighbours' labels are combined map-side. The few nodes with very many edges
    (HOT_SHARE at most) have their labels broadcast, so their edges stay dealt out. Rounds end when none
    changes a label. Each round's labels are a table in the scratch folder; the one before is dropped
    once the next is written.
    """
    both = scratch.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    total = both.count()
    if not total:
        return both.select(F.col("u").alias("node"), F.col("v").alias("label"))
    hubs = scratch.write(hot_keys(both, ["v"], total).select("v"), f"{name}-hubs")
    some = bool(hubs.limit(1).count())
    of_hubs, others = (both.join(F.broadcast(hubs), "v", "left_semi"), both.join(F.broadcast(hubs), "v", "left_anti")) if some else (None, both)
    labels = scratch.write(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        met = others.join(labels, F.col("v") == F.col("node")).select("u", "label")
        if some:
            hub_labels = labels.join(F.broadcast(hubs), F.col("node") == F.col("v"), "left_semi")
            met = met.unionByName(of_hubs.join(F.broadcast(hub_labels), F.col("v") == F.col("node")).select("u", "label"))
        near = met.groupBy("u").agg(F.min("label").alias("near"))
        pulled = labels.join(near, F.col("node") == F.col("u")).select("node", "label", F.least("label", "near").alias("pulled"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("jumped"))
        nxt = pulled.join(jump, F.col("pulled") == F.col("at")).select("node", F.least("pulled", "jumped").alias("label"), (F.least("pulled", "jumped") != F.col("label")).alias("moved"))
        table = scratch.write(nxt, f"{name}-{turn + 1}")
        moved = table.filter("moved").limit(1).count()
        scratch.drop(f"{name}-{turn}")
        labels, turn = table.select("node", "label"), turn + 1
        if not moved:
            scratch.drop(f"{name}-edges", f"{name}-hubs")
            return labels
