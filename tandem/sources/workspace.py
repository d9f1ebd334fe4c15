"""Where intermediate tables and streaming state live."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_local_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without: it gets one temporary folder. On a cluster a machine-local
    folder would be lost with its machine, so there the setting is required.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    session = spark.sparkContext.applicationId
    if session not in _local_folders:
        _local_folders[session] = tempfile.mkdtemp(prefix="tandem-")
    return _local_folders[session]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one run."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and read it back: for a costly frame that several passes read.

    The copy is columnar, so later passes read only their columns, and it outlives executors. It
    stays in the shared folder until that is cleared.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
