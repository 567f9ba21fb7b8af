"""Business records derived from the documents table, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.entities import normalise
from tessera.session import table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, doc_ord, business_name, business_address, country, h): h tells true pairs."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars").withColumn("ws", F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" Inc.", " Pvt. Ltd.", " S.A.R.L.", " Co. Ltd", " Intl Mfg", " & Sons LLC", ".com", "")]), (F.col("doc_id") % 8 + 1).cast("int"))
    short = (F.col("n_chars") % 997).cast("string")
    number = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lpad(short, 5, "0"), F.lit("b"))).otherwise(short)
    code = F.when(F.col("lang") == "de", 100000 + (F.col("n_chars") * 7919) % 900000).otherwise(10000 + (F.col("n_chars") * 7919) % 90000)
    address = F.concat(number, F.lit(" "), F.coalesce(F.get("ws", F.lit(4)), F.lit("")), F.lit(" "), F.coalesce(F.get("ws", F.lit(5)), F.lit("")), F.lit(" st "), code.cast("string"))
    return df.select(
        F.concat(F.lit("S"), (F.col("doc_id") % 3 + 1).cast("string"), F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"), F.col("doc_id").alias("doc_ord"),
        F.concat(F.array_join(F.slice("ws", 1, 4), " "), tail).alias("business_name"), F.when(F.col("doc_id") % 11 != 0, address).alias("business_address"),
        F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").when(F.col("lang") == "de", "India").alias("country"), F.md5(F.col("text").cast("binary")).alias("h"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(entities, targets) in normal form."""
    n = normalise(records(spark, sf_dir))
    return n.filter("entity_id like 'S1-%'"), n.filter("entity_id not like 'S1-%'")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("entity_id", "h")
    a, b = r.filter("entity_id like 'S1-%'").withColumnRenamed("entity_id", "s1_id"), r.filter("entity_id not like 'S1-%'").withColumnRenamed("entity_id", "target_id")
    return a.join(b, "h").select("s1_id", "target_id")
