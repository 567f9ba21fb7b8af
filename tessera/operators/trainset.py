"""Training pairs: true pairs put in, negatives thinned out, labels and class weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def inject_positives(cands: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, target_id, rank): candidates, and after them the true pairs of the same partition that retrieval missed."""
    near = truth.join(s1.select(F.col("entity_id").alias("s1_id"), "part_key"), "s1_id").join(targets.select(F.col("entity_id").alias("target_id"), F.col("part_key").alias("__p"), F.col("doc_ord").alias("__o")), "target_id")
    missed = near.filter("part_key = __p").join(cands, ["s1_id", "target_id"], "left_anti")
    last = cands.groupBy("s1_id").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("s1_id").orderBy("__o")
    added = missed.join(last, "s1_id", "left").select("s1_id", "target_id", (F.row_number().over(order) + F.coalesce("last", F.lit(0))).cast("int").alias("rank"))
    return cands.select("s1_id", "target_id", "rank").unionByName(added)


def label_pairs(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """pairs with label 1 for true ones and 0 for others."""
    missing = {"s1_id", "target_id"} - set(pairs.columns)
    if missing:
        raise ValueError(f"pairs lack columns {sorted(missing)}")
    known = truth.select("s1_id", "target_id").distinct().withColumn("__t", F.lit(1))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("__t", F.lit(0)).cast("tinyint")).drop("__t")


def prune_negatives(labelled: DataFrame, max_negatives: int = 30, head: int = 20) -> DataFrame:
    """All positives; of an entity with too many negatives the first `head` and the rest spread evenly over the others."""
    if max_negatives < 0 or head < 0:
        raise ValueError("limits of negatives can't be negative")
    head = min(head, max_negatives)
    spread = max_negatives - head
    ordered = Window.partitionBy("s1_id", "label").orderBy("rank")
    whole = Window.partitionBy("s1_id", "label")
    df = labelled.withColumn("__i", F.row_number().over(ordered) - 1).withColumn("__n", F.count("*").over(whole))
    left = F.col("__n") - head
    if spread > 1:
        # halves go to the even neighbour
        at = F.transform(F.sequence(F.lit(0), F.lit(spread - 1)), lambda i: (F.lit(head) + F.bround(i * (left - 1) / F.lit(spread - 1))).cast("int"))
    elif spread == 1:
        at = F.array(F.lit(head))
    else:
        at = F.array().cast("array<int>")
    kept = (F.col("label") == 1) | (F.col("__n") <= max_negatives) | (F.col("__i") < head) | F.array_contains(at, F.col("__i"))
    return df.filter(kept).drop("__i", "__n")


def class_weight(labelled: DataFrame) -> DataFrame:
    """One row: negatives a positive, between 1 and 5."""
    pos, neg = F.sum(F.col("label").cast("long")), F.sum(1 - F.col("label").cast("long"))
    ratio = F.coalesce(neg, F.lit(0)) / F.greatest(F.coalesce(pos, F.lit(0)), F.lit(1))
    return labelled.agg(F.coalesce(pos, F.lit(0)).alias("positives"), F.coalesce(neg, F.lit(0)).alias("negatives"), F.least(F.greatest(ratio, F.lit(1.0)), F.lit(5.0)).alias("weight"))
