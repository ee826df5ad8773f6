"""Cutting lineage with reliable checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode, as in tests, else an error."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        given = tempfile.mkdtemp(prefix="faultgrain-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(given)
    return given.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` read back from a checkpoint in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing is at yet."""
    return f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` read back from columns written to the shared folder, which take less room than a checkpoint's rows."""
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
