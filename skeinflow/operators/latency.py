"""How long answers take, by cells that merge upward: sketches of quantiles over grouping sets.

A sketch counts values by buckets whose bounds grow by a fixed factor, so a quantile read from it is off by a share of
`ERROR` at most, whatever the values. Counts of cells add up: all levels come from the finest cells, never from the
values again, and a group has no more buckets than its largest value has steps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .ordered import running

ERROR = 0.01


def times(log: DataFrame, order: Sequence[str], ms: str, block: Column) -> DataFrame:
    """Rows (session, the order columns of the end, first_ms, done_ms) of answers that are done: milliseconds from the final
    transcript that is the last one at their end to their first piece, null where that came before it, and to their end.
    ms: the log's column of times. Answers before any final transcript are none."""
    kind = F.col("kind")
    known = log.where(kind.isin("final", "chunk", "done", "clear")).select("session", "kind", *order, F.col(ms).alias("_ms"))
    rows = running(known, ["session"], order, block, counts={"_segment": kind.isin("done", "clear")}, lasts={"_asked": F.when(kind == "final", F.col("_ms"))})
    end = lambda c: F.max(F.when(F.col("kind") == "done", F.col(c))).alias(c)  # noqa: E731  one event ends a segment
    got = rows.where(kind != "final").groupBy("session", "_segment").agg(F.min(F.when(kind == "chunk", F.col("_ms"))).alias("_first"), *[end(c) for c in (*order, "_ms", "_asked")])
    first = F.when(F.col("_first") >= F.col("_asked"), F.col("_first") - F.col("_asked"))
    return got.where("_ms is not null and _asked is not null").select("session", *order, first.alias("first_ms"), (F.col("_ms") - F.col("_asked")).alias("done_ms"))


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket of a whole number; negative ones count as 0."""
    return F.ceil(F.log(F.greatest(value, F.lit(0)) + 1.0) / math.log((1 + error) / (1 - error)))


def middle(of: Column, error: float = ERROR) -> Column:
    """The whole number that stands for a bucket."""
    grow = (1 + error) / (1 - error)
    return F.floor(2 * F.pow(F.lit(grow), of) / (grow + 1) - 0.5)


def cells(rows: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """Rows (keys, bucket, n, most): the sketch of each combination of keys. Null values are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, bucket(F.col(value), error).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("most"))


#: Registers of a sketch of distinct values, as a power of two, and the share by which it is off at most in nearly all cases.
REGISTERS, DISTINCT_ERROR = 12, 0.05


def distinct_cells(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, sketch): the sketch of the distinct values of each combination of keys, as Spark stores it. Nulls are left
    out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.hll_sketch_agg(value, REGISTERS).alias("sketch"))


def distinct(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, level, about): how many values the sketches of all levels hold, `level` being how many of `keys` count, from
    the first on; the others are null."""
    sets = [[F.col(c) for c in keys[:k]] for k in range(len(keys) + 1)]
    return sketches.groupingSets(sets, *[F.col(c) for c in keys]).agg(_level(keys), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))


def _level(keys: Sequence[str]) -> Column:
    return sum((1 - F.grouping(k) for k in keys[1:]), start=1 - F.grouping(keys[0])).cast("int").alias("level")


def merged(sketches: DataFrame, fixed: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The sketches of all levels: rows (fixed, keys, level, bucket, n, most), `level` being how many of `keys` count, from the
    first on; the others are null."""
    sets = [[*fixed, "bucket", *keys[:k]] for k in range(len(keys) + 1)]
    columns = [*fixed, "bucket", *keys]
    return sketches.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(_level(keys), F.sum("n").alias("n"), F.max("most").alias("most"))


def quantiles(sketches: DataFrame, by: Sequence[str], wanted: dict[str, tuple[int, int]], error: float = ERROR) -> DataFrame:
    """Rows (by, n, most, and each wanted quantile): the least bucket's number that a share of the values, a fraction of whole
    numbers, doesn't pass. It is off by `error` of the value plus 1 at most."""
    own = Window.partitionBy(*by).orderBy("bucket")
    upto = sketches.withColumn("_upto", F.sum("n").over(own)).withColumn("_all", F.sum("n").over(Window.partitionBy(*by)))
    least = lambda a, b: F.min(F.when(F.col("_upto") * b >= F.col("_all") * a, F.col("bucket")))
    return upto.groupBy(*by).agg(F.sum("n").alias("n"), F.max("most").alias("most"), *[middle(least(a, b), error).alias(name) for name, (a, b) in wanted.items()])
