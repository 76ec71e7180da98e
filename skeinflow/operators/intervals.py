"""Joins of points with the spans of time that they fall into, and sessions by gaps of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

#: Points of one key and bin that one task joins.
HOT = 100_000


def inside(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, start: str, end: str, width: int, hot: int = HOT) -> DataFrame:
    """The points with each span of the same key that they fall into: start <= at < end, whole numbers. Columns of
    `spans` but for the key are added; their names must differ from those of `points`.

    Time is cut into bins of `width`; a span is in every bin that it touches, so the width should be about as long as
    spans are. Bins with more than `hot` points are dealt over several tasks, each with the bin's spans. Nulls fall into
    nothing."""
    own = points
    for c in (*key, at):
        own = own.where(F.col(c).isNotNull())
    own = own.withColumn("_bin", F.floor(F.col(at) / width))
    binned = spans.where(F.col(start) < F.col(end)).withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    crowded = own.groupBy(*key, "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    crowded = crowded.select(*[F.col(k).alias(f"_c_{k}") for k in key], F.col("_bin").alias("_c"), F.ceil(F.col("_n") / hot).alias("_parts"))

    def parted(rows: DataFrame, bin_: str) -> DataFrame:
        on = F.col(bin_) == F.col("_c")
        for k in key:
            on = on & (F.col(k) == F.col(f"_c_{k}"))
        return rows.join(crowded, on, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))).drop("_c", *[f"_c_{k}" for k in key])

    left = parted(own, "_bin").withColumn("_part", F.pmod(F.xxhash64(at, *[c for c in points.columns if c != at]), "_parts")).drop("_parts")
    right = parted(binned, "_b").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    right = right.select(*[F.col(k).alias(f"_s_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = (F.col("_bin") == F.col("_b")) & (F.col("_part") == F.col("_p")) & (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))
    for k in key:
        on = on & (F.col(k) == F.col(f"_s_{k}"))
    return left.join(right, on).select(*points.columns, *[c for c in spans.columns if c not in key])


def sessions(rows: DataFrame, key: Sequence[str], at: str, gap: int, order: Sequence[str], block: Column) -> DataFrame:
    """Rows (key, start, end, n): stretches of rows of a key between which no time of `gap` or more passes; `end` is the last
    row's time plus the gap. order: rises with `at`. Stretches go on across blocks, and a key is as many groups as it has
    stretches."""
    known = running(rows.select(*key, *dict.fromkeys([*order, at])), key, order, block, before={"_was": F.col(at)})
    new = F.col("_was").isNull() | (F.col(at) - F.col("_was") >= gap)
    numbered = running(known.withColumn("_new", new), key, order, block, counts={"_earlier": F.col("_new")})
    stretch = F.col("_earlier") + F.when(F.col("_new"), 1).otherwise(0)
    return numbered.groupBy(*key, stretch.alias("_stretch")).agg(F.min(at).alias("start"), (F.max(at) + gap).alias("end"), F.count("*").alias("n")).drop("_stretch")


def stream_sessions(rows: DataFrame, key: Sequence[str], ts_ms: str, gap_ms: int, delay: str) -> DataFrame:
    """The same of a stream: a stretch is given when the watermark has passed its end. Rows later than that are dropped."""
    timed = rows.withColumn("_at", F.timestamp_millis(ts_ms)).withWatermark("_at", delay)
    got = timed.groupBy(*key, F.session_window("_at", f"{gap_ms} milliseconds").alias("_w")).agg(F.count("*").alias("n"))
    return got.select(*key, F.unix_millis("_w.start").alias("start"), F.unix_millis("_w.end").alias("end"), "n")
