"""Tab-separated sources and sinks of the linkage pipeline, and its run metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("entity_id", "business_name", "business_address", "country")
SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
#: What counts as null in every column.
NULLS = ("", "NA", "null")
CSV = {"sep": "\t", "header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"'}


def as_nulls(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(F.col(c).isin(*NULLS), None).otherwise(F.col(c)).alias(c) for c in df.columns])


def read_source(spark: SparkSession, path: str, usecols: list[str] | None = None, nrows: int | None = None) -> DataFrame:
    """The records of a file, columns by the names in its header and all of them strings; usecols picks columns and nrows the first rows.

    A file is read in splits unless a line holds an odd number of quotes: then a field may go on in the next line."""
    odd = spark.read.text(path).filter(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)
    found = spark.read.options(**CSV, multiLine=str(not odd.isEmpty()).lower()).csv(path)
    if not found.columns:  # not even a header
        found = spark.createDataFrame([], SCHEMA)
    missing = [c for c in usecols or COLUMNS if c not in found.columns]
    if missing:
        raise ValueError(f"{path} has no columns {missing}")
    df = as_nulls(found.select(*[F.col(f"`{c}`") for c in found.columns if c in COLUMNS or c in (usecols or ())]))
    df = df.select(*(usecols or COLUMNS))
    return df if nrows is None else df.limit(nrows)


def with_position(df: DataFrame, first: int = 0) -> DataFrame:
    """Adds doc_ord: an order that follows files and the rows in them."""
    return df.withColumn("doc_ord", F.monotonically_increasing_id() + first)


def read_targets(spark: SparkSession, *paths: str) -> DataFrame:
    """The union of target files with doc_ord, earlier files first."""
    out = None
    for i, path in enumerate(paths):
        one = with_position(read_source(spark, path), i << 60)
        out = one if out is None else out.unionByName(one)
    return out


def read_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spine, pairs): the entities (s1_id) that a truth file names, and its true pairs (s1_id, target_id).

    The header and blank lines are left out, a line is split at its first tab, ids are trimmed, and the last of
    several lines for an entity counts."""
    lines = spark.read.text(path).withColumn("__n", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    header = lines.agg(F.min("__n")).first()[0]
    rows = lines.filter(F.col("__n") != (header if header is not None else -1))
    tab = F.instr("value", "\t")
    left = F.when(tab > 0, F.substring_index("value", "\t", 1)).otherwise(F.col("value"))
    right = F.when(tab > 0, F.expr("substr(value, instr(value, '\t') + 1)")).otherwise("")
    rows = rows.select(F.trim(left).alias("s1_id"), right.alias("ids"), "__n").filter("s1_id <> ''")
    rows = rows.groupBy("s1_id").agg(F.max_by("ids", "__n").alias("ids"))
    pairs = rows.select("s1_id", F.explode(F.split("ids", ",")).alias("t")).select("s1_id", F.trim("t").alias("target_id")).filter("target_id <> ''").distinct()
    return rows.select("s1_id"), pairs


def submission(spine: DataFrame, pairs: DataFrame, id_header: str, list_header: str) -> DataFrame:
    """One row per entity of spine (s1_id, ord): its sorted distinct targets joined by commas, empty for none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.sort_array(F.collect_set("target_id")), ",").alias("__l"))
    out = spine.join(lists, "s1_id", "left").select(F.col("s1_id").alias(id_header), F.coalesce("__l", F.lit("")).alias(list_header), "ord")
    return out


def candidate_submission(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    return submission(spine, pairs, "source1_entity_id", "candidate_entity_ids")


def match_submission(spine: DataFrame, pairs: DataFrame) -> DataFrame:
    return submission(spine, pairs, "source1_entity_id", "matched_entity_ids")


def write_submission(df: DataFrame, path: str) -> None:
    """Writes a submission as text in spine order: a header, then unquoted tab-separated rows, in one file as its
    readers expect. The order comes from a range sort; only the last write is one task, which streams."""
    a, b, _ = df.columns
    head = df.sparkSession.createDataFrame([(-1, f"{a}\t{b}")], "ord long, value string")
    rows = df.select(F.col("ord").cast("long").alias("ord"), F.concat_ws("\t", F.col(a), F.col(b)).alias("value"))
    head.unionByName(rows).orderBy("ord").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_metadata(spark: SparkSession, path: str, metadata: dict) -> None:
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str, threshold: float | None = None) -> tuple[float, dict[str, float]]:
    """(tau, country thresholds); an explicit threshold wins, and what can't be read gives 0.5 and no countries."""
    if threshold is not None:
        return float(threshold), {}
    try:
        found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
        return float(found.get("best_tau", 0.5)), {str(k): float(v) for k, v in (found.get("country_thresholds") or {}).items()}
    except Exception:  # noqa: BLE001  any unreadable metadata means defaults
        return 0.5, {}


def in_file_order(df: DataFrame) -> DataFrame:
    """Adds ord 1..n by doc_ord; ranks within slices of the order, so that no task sorts all rows."""
    sized = df.withColumn("__p", F.shiftright("doc_ord", 33))
    n = sized.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per file part
    n = n.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    w = Window.partitionBy("__p").orderBy("doc_ord")
    return sized.withColumn("__r", F.row_number().over(w)).join(n, "__p").withColumn("ord", F.col("__b") + F.col("__r")).drop("__p", "__r", "__b")
