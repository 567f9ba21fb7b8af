"""Session helpers: shared work folders, worker import paths, durable intermediate tables."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_LOCAL: dict[str, str] = {}
_HELD: dict[str, dict] = {}
#: Python workers live long and do very different things in turn: they have few heaps, and don't start threads of their own.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "OMP_NUM_THREADS": "1", "OPENBLAS_NUM_THREADS": "1"}


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Bounds Arrow batches and lets Python workers import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for k, v in WORKERS.items():
        env.setdefault(k, v)


def held(owner: str) -> dict:
    """What this Python worker keeps from task to task for an operator; what others kept is let go, and memory given back."""
    others = [k for k in _HELD if k != owner]
    for k in others:
        del _HELD[k]
    if others and sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)
    return _HELD.setdefault(owner, {})


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="tessera-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._tessera_path = path
    return out


def drop_stored(*frames: DataFrame) -> None:
    """Deletes tables made by stored() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_tessera_path", None)
        if path:
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
