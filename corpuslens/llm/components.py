"""Connected components of an edge table by alternating neighbour minima and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, comp), written: the smallest node reachable from each node of edges (x, y).

    Each round takes the least label among neighbours, then the label's own
    label, until nothing changes; labels only fall, so paths shorten by doubling.
    Every round is a written table.
    """
    both = store.put(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(), "edges")
    labels = store.put(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # A label's own label is at hand, so the jump needs no second table of labels.
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        new = store.put(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("fell")), "labels")
        changed = new.where("fell").limit(1).count()
        store.drop(labels)
        labels = new
        if not changed:
            store.drop(both)
            return labels.select("node", "comp")
