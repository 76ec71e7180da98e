"""How queries run streams: sessions of their own, input that comes in micro-batches and out of order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import folders, wire
from ..streaming import fold

#: Files of a micro-batch, at least, and the rows for which there is one more.
FILES, ROWS = 4, 200_000
#: Rows of a stream for which its state has one more part: what timers give in a batch is a part's at once, in memory.
PART = 1_000_000


def session(spark: SparkSession, rows: int = 0) -> SparkSession:
    """A session for streams beside the caller's, whose settings stay as they are: state in RocksDB, in no more parts than
    there are cores, but for streams of very many `rows`."""
    own, parts = spark.newSession(), "spark.sql.shuffle.partitions"
    own.conf.set("spark.sql.streaming.stateStore.providerClass", fold.PROVIDER)
    own.conf.set(parts, str(max(min(int(spark.conf.get(parts)), spark.sparkContext.defaultParallelism), rows // PART)))
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return own


def files(rows: int, batches: int) -> int:
    """How many files a micro-batch has, of so many rows in all."""
    return max(FILES, rows // (batches * ROWS))


def deliver(rows: DataFrame, batch: Column, batches: int, path: str, number: int, last: DataFrame | None = None) -> None:
    """Writes `rows` as JSON lines, `number` files for each of the numbers 0 to `batches` - 1 that `batch` gives, in their
    order; `last` comes with the last. It reads the rows for each number: they are `folders.stored`."""
    for i in range(batches):
        some = rows.where(batch == i)
        if last is not None and i == batches - 1:
            some = some.unionByName(last)
        some.repartition(number).write.mode("append").json(path)


def beat(spark: SparkSession, ts_ms: int, schema: str = wire.EVENT_LOG) -> DataFrame:
    """The last row of an input, of a session that has no other: it lets the watermark pass all rows before `ts_ms`."""
    one = spark.range(1).selectExpr("'' as session", "0L as seq", f"{ts_ms}L as ts_ms")
    return spark.createDataFrame([], schema).unionByName(one, allowMissingColumns=True)


def written(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """What a stream has written, read by the caller's session."""
    return spark.read.schema(schema).parquet(f"{folder}/out")


def events(spark: SparkSession, path: str, schema: str = wire.EVENT_LOG, number: int = FILES) -> DataFrame:
    """Rows of a folder as a stream, so many files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", number).json(path)


def shuffled(rows: DataFrame, delay_ms: int, batches: int) -> tuple[Column, int]:
    """The micro-batch of each row, when rows come in disorder of up to `delay_ms`, and the time of the last beat: a row
    arrives by its time and up to the delay later, by a hash of its number."""
    lo, hi = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    width = (hi + delay_ms - lo) // batches + 1
    arrives = F.col("ts_ms") + F.pmod(F.xxhash64("session", "seq"), F.lit(delay_ms))
    return F.floor((arrives - lo) / width).cast("int"), hi + 2 * delay_ms


def run(spark: SparkSession, name: str, inputs: dict[str, DataFrame], build: Callable[..., DataFrame], delay_ms: int, batches: int = 3, schema: str = wire.EVENT_LOG) -> str:
    """Delivers each of `inputs` out of order and runs what `build` makes of their streams to the end; its folder."""
    folder, kept = folders.new(spark, name), {k: folders.stored(rows) for k, rows in inputs.items()}
    counts = {k: rows.count() for k, rows in kept.items()}
    own, streams = session(spark, sum(counts.values())), {}
    for k, rows in kept.items():
        number = files(counts[k], batches)
        batch, last = shuffled(rows, delay_ms, batches)
        deliver(rows, batch, batches, f"{folder}/{k}", number, beat(spark, last, schema))
        streams[k] = events(own, f"{folder}/{k}", schema, number)
    fold.to_files(build(**streams), f"{folder}/out", f"{folder}/at").awaitTermination()
    return folder
