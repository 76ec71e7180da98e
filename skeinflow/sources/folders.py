"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a session on one machine takes a folder of its own;
    a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = sc.getCheckpointDir()
    return folder


def new(spark: SparkSession, name: str) -> str:
    """A new folder's path."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, path: str | None = None) -> DataFrame:
    """`rows`, written once and read again from there: what made them doesn't run twice."""
    path = path or new(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
