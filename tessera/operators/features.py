"""The 22 features of a candidate pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.similarity import FUZZY, fuzzy

FEATURES = (
    "jw_sim", "token_sort", "token_set", "lev_ratio", "exact_match", "partial_ratio", "wratio", "token_exact",
    "name_jaccard", "trigram_jaccard", "name_len_ratio", "token_containment", "token_count_diff", "addr_token_sort",
    "addr_token_set", "addr_lev_ratio", "addr_jaccard", "addr_missing", "postal_match", "num_match", "combined_score",
    "name_addr_geom",
)
SIDE = ("name", "core", "addr", "toks", "tri", "addr_toks", "postal", "numbers")


def pair_sides(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs (s1_id, target_id) with both entities' normal forms; pairs that lack a side go.

    Targets that no pair names are left out before their strings are shuffled."""
    left = s1.join(pairs.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(F.col("entity_id").alias("s1_id"), *[F.col(c).alias(f"l_{c}") for c in SIDE])
    right = targets.join(pairs.select(F.col("target_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(F.col("entity_id").alias("target_id"), *[F.col(c).alias(f"r_{c}") for c in SIDE])
    return pairs.join(left, "s1_id").join(right, "target_id")


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def set_features() -> dict[str, Column]:
    """The features that need no fuzzy matching."""
    c = lambda n: (F.col(f"l_{n}"), F.col(f"r_{n}"))
    (core1, core2), (toks1, toks2), (addr1, addr2), (post1, post2), (num1, num2) = c("core"), c("toks"), c("addr"), c("postal"), c("numbers")
    len1, len2 = F.length(core1), F.length(core2)
    n1, n2, s1, s2 = F.size(num1), F.size(num2), F.size(toks1), F.size(toks2)
    return {
        "exact_match": ((core1 == core2) & (len1 > 0)).cast("double"),
        "token_exact": ((toks1 == toks2) & (s1 > 0)).cast("double"),
        "name_jaccard": _jaccard(toks1, toks2),
        "trigram_jaccard": _jaccard(*c("tri")),
        "name_len_ratio": F.when(F.greatest(len1, len2) > 0, F.least(len1, len2) / F.greatest(len1, len2)).otherwise(0.0),
        "token_containment": F.when((s1 > 0) & (s2 > 0), F.size(F.array_intersect(toks1, toks2)) / F.least(s1, s2)).otherwise(0.0),
        "token_count_diff": F.abs(s1 - s2).cast("double"),
        "addr_jaccard": _jaccard(*c("addr_toks")),
        "addr_missing": (F.when(addr1 == "", 0.5).otherwise(0.0) + F.when(addr2 == "", 0.5).otherwise(0.0)),
        "postal_match": F.when((post1 == "") | (post2 == ""), 0.0).when(post1 == post2, 1.0).otherwise(-1.0),
        "num_match": F.when((n1 == 0) & (n2 == 0), 0.5).when((n1 == 0) | (n2 == 0), 0.0).otherwise(_jaccard(num1, num2)),
    }


def combined(token_sort: Column, addr_token_sort: Column, present: Column) -> tuple[Column, Column]:
    """The combined score and the geometric mean of name and address."""
    score = F.when(present, token_sort * addr_token_sort).otherwise(token_sort * F.when(token_sort > 0.85, 0.85).otherwise(0.5))
    geom = F.when(present, F.sqrt(token_sort * F.greatest(addr_token_sort, F.lit(0.01)))).otherwise(token_sort)
    return score, geom


def pair_features(pairs: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """(s1_id, target_id, the 22 features as floats, and the pairs' other columns)."""
    sides = pair_sides(pairs, s1, targets)
    scored = sides.withColumn("fz", fuzzy("l_", "r_"))
    values = set_features()
    for name in FUZZY:
        values[name] = F.col(f"fz.{name}")
    present = (F.col("l_addr") != "") & (F.col("r_addr") != "")
    values["combined_score"], values["name_addr_geom"] = combined(values["token_sort"], values["addr_token_sort"], present)
    rest = [c for c in pairs.columns if c not in ("s1_id", "target_id")]
    return scored.select("s1_id", "target_id", *rest, *[values[f].cast("float").alias(f) for f in FEATURES])
