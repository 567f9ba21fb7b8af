"""Matches from scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_source(target_id: Column) -> Column:
    """S2 or S3 by the id's prefix, which is case-sensitive; null for any other id."""
    return F.when(target_id.startswith("S2-"), "S2").when(target_id.startswith("S3-"), "S3")


def probability_floor(scored: DataFrame, floor: float = 0.05) -> DataFrame:
    return scored.filter(F.col("match_prob") >= floor)


def select_pairs(scored: DataFrame, threshold: float = 0.5, max_per_source: int | None = None, threshold_by_s1: DataFrame | None = None) -> DataFrame:
    """(s1_id, target_id, match_prob) of the pairs that reach their entity's threshold.

    max_per_source keeps that many best pairs of each entity and source before the threshold is applied, ties in
    candidate order (column rank, else the target's id). threshold_by_s1 has (s1_id, tau)."""
    df = scored.withColumn("__source", target_source(F.col("target_id"))).filter("__source is not null and match_prob is not null")
    if max_per_source is not None:
        tie = F.col("rank") if "rank" in scored.columns else F.col("target_id")
        w = Window.partitionBy("s1_id", "__source").orderBy(F.desc("match_prob"), tie)
        df = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_per_source)
    tau = F.lit(threshold)
    if threshold_by_s1 is not None:
        df = df.join(threshold_by_s1.select("s1_id", F.col("tau").alias("__tau")), "s1_id", "left")
        tau = F.coalesce("__tau", tau)
    return df.filter(F.col("match_prob") >= tau).select("s1_id", "target_id", "match_prob")


def on_spine(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, ids): every entity with its sorted distinct targets, none for those without."""
    lists = pairs.groupBy("s1_id").agg(F.sort_array(F.collect_set("target_id")).alias("ids"))
    out = s1.select(F.col("entity_id").alias("s1_id")).join(lists, "s1_id", "left")
    return out.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
