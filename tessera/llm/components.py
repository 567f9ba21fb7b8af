"""Connected components of a link table, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import drop_stored, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of a link, component being the smallest node reachable.

    First each node's links are hung on its smallest neighbour. Then each round takes the smallest label among a node's neighbours and then the label of its label, so labels
    travel twice as far each round. Sums and minima are combined before the shuffle; a hub's links are never
    gathered. Each round ends in a stored table. An empty link table gives no rows.
    """
    pairs = edges.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("other")).filter("node <> other").distinct()
    # a node's links to smaller nodes become one link to the smallest and links between those, which many nodes share
    least = pairs.groupBy("node").agg(F.min("other").alias("least"))
    hung = pairs.join(least, "node").select(F.explode(F.array(F.struct("node", F.col("least").alias("other")), F.struct(F.col("other").alias("node"), F.col("least").alias("other")))).alias("p"))
    pairs = hung.select("p.node", "p.other").filter("node <> other").distinct()
    both = stored(pairs.union(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        reached = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        nearer = labels.join(reached, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = stored(nearer.join(jump, "near", "left").select("node", "old", F.least("near", F.coalesce("far", "near")).alias("label")), "labels")
        changed = not new.filter("label <> old").isEmpty()
        drop_stored(labels)
        labels = new
        if not changed:
            drop_stored(both)
            return labels.select("node", F.col("label").alias("component"))
