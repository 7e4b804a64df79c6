"""The folder that driver and executors share, plan-cutting writes to it, and the size of the batches that go to Python."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used by sessions on one machine that name no shared folder, as in tests.
LOCAL_SHARED_DIR = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share; a session of many machines has to name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Lowers the session's Arrow batch to so many rows: a batch of whole texts has to fit beside the worker's heap.

    A smaller figure that the session already has is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
