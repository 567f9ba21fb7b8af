"""Records that arrive as files: a streaming source, and linkage of each micro-batch against stored targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import blocking, entities, features, model, select
from tessera.sources.tsv import CSV, SCHEMA, as_nulls, with_position


def stream_source(spark: SparkSession, folder: str, files_per_trigger: int = 1, usecols: list[str] | None = None) -> DataFrame:
    """The records of the files that appear in a folder, a few files a micro-batch."""
    df = as_nulls(spark.readStream.options(**CSV).option("maxFilesPerTrigger", files_per_trigger).schema(SCHEMA).csv(folder))
    return df.select(*usecols) if usecols else df


def link_stream(records: DataFrame, targets: DataFrame, fitted, output: str, checkpoint: str, tau: float = 0.5, top_k: int = 300) -> StreamingQuery:
    """Matches of arriving records with targets in normal form, written a folder a micro-batch.

    Document frequencies are those of the targets, so a micro-batch is linked as a batch run would link it.
    Each micro-batch overwrites its own folder, so one that is run again leaves nothing twice."""

    def link(batch: DataFrame, number: int) -> None:
        s1 = entities.normalise(with_position(batch))
        cands = blocking.candidates(s1, targets, top_k).select("s1_id", "target_id")
        scored = select.probability_floor(model.score(fitted, features.pair_features(cands, s1, targets)))
        select.select_pairs(scored, tau).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return records.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
