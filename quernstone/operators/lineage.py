"""Cutting lineage, and broadcasts behind a check of size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side of counted rows is broadcast.
BROADCAST_BYTES = 32 << 20


def _folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: that of spark.checkpoint.dir, or one of this machine where that is unset and the master is local."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if at is None and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(at or tempfile.mkdtemp(prefix="quernstone-"))
    return context.getCheckpointDir()


def shared(spark: SparkSession, name: str) -> str:
    """A folder of this session's own among its checkpoints."""
    return f"{_folder(spark)}/{name}"


def cut(df: DataFrame) -> DataFrame:
    """df read back from files in the folder of checkpoints: computed once, where a checkpoint computes its last stage again, and in columns."""
    spark = df.sparkSession
    folder = shared(spark, f"cut-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """df with a broadcast hint if its counted rows fit."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
