"""What blocking finds and misses, overall and by country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.blocking import DEFAULT_CHANNELS, candidates
from tessera.operators.entities import UNKNOWN
from tessera.operators.metrics import entity_counts, entity_f05

def known_country() -> Column:
    return F.when(F.coalesce(F.col("country"), F.lit("")) == "", UNKNOWN).otherwise(F.col("country"))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select("s1_id", "target_id").distinct()


def candidate_recall(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (gt_pairs, retrieved, recall)."""
    hits = _pairs(truth).join(_pairs(cands).withColumn("__c", F.lit(1)), ["s1_id", "target_id"], "left")
    out = hits.agg(F.count("*").alias("gt_pairs"), F.count("__c").alias("retrieved"))
    return out.withColumn("recall", F.when(F.col("gt_pairs") > 0, F.col("retrieved") / F.col("gt_pairs")).otherwise(0.0))


def full_coverage(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (entities, covered, coverage): entities with true pairs, and those whose true pairs are all candidates."""
    hits = _pairs(truth).join(_pairs(cands).withColumn("__c", F.lit(1)), ["s1_id", "target_id"], "left")
    each = hits.groupBy("s1_id").agg(F.min(F.coalesce("__c", F.lit(0))).alias("all_in"))
    out = each.agg(F.count("*").alias("entities"), F.coalesce(F.sum("all_in"), F.lit(0)).cast("long").alias("covered"))
    return out.withColumn("coverage", F.when(F.col("entities") > 0, F.col("covered") / F.col("entities")).otherwise(0.0))


def oracle_predictions(cands: DataFrame, truth: DataFrame) -> DataFrame:
    """True pairs among the candidates: what a perfect classifier would predict."""
    return _pairs(truth).join(_pairs(cands), ["s1_id", "target_id"], "left_semi")


def cross_country(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """One row (cross_country, missing_target): true pairs between countries, and with targets that don't exist."""
    left = s1.select(F.col("entity_id").alias("s1_id"), F.coalesce("country", F.lit("")).alias("c1"))
    right = targets.select(F.col("entity_id").alias("target_id"), F.coalesce("country", F.lit("")).alias("c2"))
    both = _pairs(truth).join(left, "s1_id").join(right, "target_id", "left")
    return both.agg(F.count(F.when(F.col("c2").isNotNull() & (F.col("c1") != F.col("c2")), 1)).alias("cross_country"), F.count(F.when(F.col("c2").isNull(), 1)).alias("missing_target"))


def miss_signatures(cands: DataFrame, truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """By country: missed true pairs, and how many of them share a core name, a name token, a postal code or a
    number. Both sides are read under the first side's country."""
    missed = _pairs(truth).join(_pairs(cands), ["s1_id", "target_id"], "left_anti")
    a = s1.select(F.col("entity_id").alias("s1_id"), known_country().alias("country"), F.col("name").alias("n1"), F.col("business_address").alias("a1"))
    b = targets.select(F.col("entity_id").alias("target_id"), F.col("name").alias("n2"), F.col("business_address").alias("a2"))
    df = missed.join(a, "s1_id").join(b, "target_id")
    for i in "12":
        df = df.withColumn(f"c{i}", T.core_name(F.col(f"n{i}"), F.col("country"))).withColumn(f"t{i}", T.name_tokens(F.col(f"c{i}")))
        df = df.withColumn(f"p{i}", T.postal_code(F.col(f"a{i}"), F.col("country"))).withColumn(f"m{i}", T.numbers(F.col(f"a{i}"), F.col(f"p{i}")))
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    return df.groupBy("country").agg(
        F.count("*").alias("missed_pairs"), n((F.col("c1") != "") & (F.col("c1") == F.col("c2")), "exact_core_name"), n(F.arrays_overlap("t1", "t2"), "name_token_overlap"),
        n((F.col("p1") != "") & (F.col("p1") == F.col("p2")), "postal_match"), n(F.arrays_overlap("m1", "m2"), "address_number_overlap"),
    )


def country_report(s1: DataFrame, cands: DataFrame, predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """By country and in total (country null): entities, candidate recall, coverage, precision and recall over
    entities with true pairs, accuracy over the others, and macro F0.5."""
    spine = s1.select(F.col("entity_id").alias("s1_id"), known_country().alias("country"))
    retrieved = oracle_predictions(cands, truth).groupBy("s1_id").agg(F.count("*").alias("hit"))
    c = entity_counts(spine, predicted, truth).join(retrieved, "s1_id", "left").fillna(0, ["hit"])
    has = F.col("n_gt") > 0
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = total(F.when(has, F.col("tp"))), total(F.when(has, F.col("n_pred") - F.col("tp"))), total(F.when(has, F.col("n_gt") - F.col("tp")))
    return c.rollup("country").agg(
        F.count("*").alias("entities"), share(total(F.col("hit")), total(F.col("n_gt"))).alias("candidate_recall"),
        share(F.count(F.when(has & (F.col("hit") == F.col("n_gt")), 1)), F.count(F.when(has, 1))).alias("full_coverage"),
        share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"),
        share(F.count(F.when(~has & (F.col("n_pred") == 0), 1)), F.count(F.when(~has, 1))).alias("singleton_accuracy"),
        F.avg(entity_f05(F.col("tp"), F.col("n_pred"), F.col("n_gt"))).alias("macro_f05"),
    )


def channel_ablation(s1: DataFrame, targets: DataFrame, truth: DataFrame, top_k: int = 300) -> DataFrame:
    """Candidate recall with all default channels, without each of them, and with prefixes."""
    variants = {"default": DEFAULT_CHANNELS, "with_prefix": (*DEFAULT_CHANNELS, "prefix")} | {f"without_{c}": tuple(x for x in DEFAULT_CHANNELS if x != c) for c in DEFAULT_CHANNELS}
    out = None
    for name, channels in variants.items():
        row = candidate_recall(candidates(s1, targets, top_k, channels), truth).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def cap_ablation(s1: DataFrame, targets: DataFrame, truth: DataFrame, caps: tuple[int, ...] = (150, 300), wide: int = 500, top_k: int = 300) -> DataFrame:
    """Candidate recall when ranked lists are cut at each cap, and with a wider retrieval."""
    base, out = candidates(s1, targets, top_k), None
    parts = [(f"cap_{c}", base.filter(F.col("rank") <= c)) for c in caps] + [(f"cap_{wide}", candidates(s1, targets, wide).filter(F.col("rank") <= wide))]
    for name, cands in parts:
        row = candidate_recall(cands, truth).withColumn("variant", F.lit(name))
        row = row.crossJoin(cands.agg(F.count("*").alias("pairs")))
        out = row if out is None else out.unionByName(row)
    return out
