"""Answers inside a stream, each request asked once: a ledger of answers by micro-batch.

A micro-batch holds the same requests whenever it is run again. Its answers are written before anything is done with them,
and marked complete after that; a run that finds the mark reads them and asks nobody."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import answers


def _there(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.schema("id long").parquet(path).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def answered(requests: DataFrame, path: str, number: int, provider: answers.Provider = answers.echo) -> DataFrame:
    """What `answers.told` gives for the requests of a micro-batch, asked for only if the ledger hasn't got it. If a task is
    lost before the answers are written, its requests are asked again; none is after that."""
    spark, told = requests.sparkSession, answers.told(requests, provider)
    if not _there(spark, f"{path}/complete/batch={number}"):
        told.write.mode("overwrite").parquet(f"{path}/answers/batch={number}")
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}/complete/batch={number}")
    return spark.read.schema(told.schema).parquet(f"{path}/answers/batch={number}")


def to_ledger(requests: DataFrame, path: str, checkpoint: str, provider: answers.Provider = answers.echo, sinks: Sequence[Callable[[DataFrame], None]] = (), once: bool = True) -> StreamingQuery:
    """Answers the requests of a stream (topic, template, question and others), and gives each sink each micro-batch's answers. A
    batch that is run again reaches the sinks again, with the same answers."""

    def send(batch: DataFrame, number: int) -> None:
        got = answered(batch, path, number, provider)
        for sink in sinks:
            sink(got)

    writer = requests.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """All answers of the ledger that are complete."""
    done = spark.read.parquet(f"{path}/complete").select(F.col("batch").alias("_done")).distinct()
    return spark.read.parquet(f"{path}/answers").join(done, F.col("batch") == F.col("_done"), "left_semi").drop("batch")
