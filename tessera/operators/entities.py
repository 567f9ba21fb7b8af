"""Entities in normal form, and their partitions by country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

UNKNOWN = "__UNKNOWN__"


def part_key(country: Column) -> Column:
    """The partition of a country: unknown for null or empty, none for white space."""
    return F.when(F.coalesce(country, F.lit("")) == "", UNKNOWN).when(F.trim(country) != "", country)


def partitions(df: DataFrame) -> DataFrame:
    """Partitions in order, the unknown one last."""
    keys = df.select(part_key(F.col("country")).alias("part_key")).filter("part_key is not null").distinct()
    return keys.orderBy(F.col("part_key") == UNKNOWN, "part_key")


def union_targets(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def normalise(df: DataFrame) -> DataFrame:
    """Adds to (entity_id, doc_ord, business_name, business_address, country) what blocking and features need.

    Blocking reads numbers and postal codes off the address as written and without a country; features read
    them off the cleaned address with it."""
    known = F.coalesce("country", F.lit(""))
    df = df.withColumn("part_key", part_key(F.col("country"))).withColumn("name", T.clean_text(F.col("business_name"))).withColumn("addr", T.clean_address(F.col("business_address")))
    df = df.withColumn("core", T.core_name(F.col("name"), known))
    df = df.withColumn("tokens", T.name_tokens(F.col("core"))).withColumn("toks", F.array_sort(F.array_distinct(T.words(F.col("core")))))
    df = df.withColumn("tri", T.trigrams(F.col("core"))).withColumn("addr_toks", F.array_sort(F.array_distinct(T.words(F.col("addr")))))
    df = df.withColumn("raw_postal", T.postal_code(F.col("business_address"))).withColumn("raw_numbers", T.numbers(F.col("business_address"), F.col("raw_postal")))
    df = df.withColumn("postal", T.postal_code(F.col("addr"), known)).withColumn("numbers", T.numbers(F.col("addr"), F.col("postal")))
    return df.withColumn("streets", T.street_words(F.col("addr")))


def random_sample(df: DataFrame, n: int | None, id_col: str = "entity_id", whole: int = 2_200_000) -> DataFrame:
    """n rows chosen by a hash of the id, the same ones each time; all rows for no n, 0 or less, or a very large n."""
    if n is None or n <= 0 or n >= whole:
        return df
    return df.orderBy(F.md5(F.col(id_col).cast("binary")), id_col).limit(n)


def stratified_split(df: DataFrame, fraction: float, stratum: str = "country", id_col: str = "entity_id") -> DataFrame:
    """Adds is_validation: the share `fraction` of each stratum, rounded up, by a hash of the id.

    Each stratum is ranked in 256 slices by the hash's first two digits, so no stratum is sorted in one task;
    a row's rank is its rank in its slice and the rows in the slices before."""
    hashed = df.withColumn("__h", F.md5(F.col(id_col).cast("binary")))
    w = Window.partitionBy(stratum, F.substring("__h", 1, 2)).orderBy("__h", id_col)
    slices = hashed.groupBy(stratum, F.substring("__h", 1, 2).alias("__s")).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(stratum).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(stratum)
    slices = slices.select(F.col(stratum).alias("__k"), "__s", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__total"))
    ranked = hashed.withColumn("__r", F.row_number().over(w)).withColumn("__s", F.substring("__h", 1, 2))
    joined = ranked.join(slices, F.col(stratum).eqNullSafe(F.col("__k")) & (ranked["__s"] == slices["__s"]))
    return joined.select(*[df[c] for c in df.columns], (F.col("__before") + F.col("__r") <= F.ceil(F.col("__total") * fraction)).alias("is_validation"))


def fold(id_col: Column, k: int) -> Column:
    """A fold in 0..k-1 by a hash of the group's id, so that a group is never split."""
    return F.pmod(F.conv(F.substring(F.md5(id_col.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")
