"""Audio in runs of any length, packed into blocks of a fixed number of frames.

Frames of a session are numbered through its runs; what a run leaves over begins the next block. Each run learns the
number of its first frame from the lengths before it, and is cut where blocks end, so a session is as many groups as it
has blocks, and each group has the frames of one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import by_number, running

FRAMES = 4096


def packed(runs: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None, frames: int = FRAMES, rest: bool = False) -> DataFrame:
    """Rows (session, block, samples) of `runs(session, samples, ...)`: blocks of `frames` samples, numbered from 0 in each session.

    rest: gives the last, shorter block too; else it isn't one yet. Null and empty runs have no frames; runs with a null
    session or order are dropped; a run longer than a block makes several."""
    own = runs.select("session", "samples", *order).where(F.size("samples") > 0).withColumn("_len", F.size("samples"))
    placed = running(own, ["session"], order, by_number(order[0]) if block is None else block, sums={"_from": F.col("_len")})
    first, last = F.floor(F.col("_from") / frames), F.floor((F.col("_from") + F.col("_len") - 1) / frames)
    cut = placed.withColumn("block", F.explode(F.sequence(first, last)))
    start, end = F.greatest(F.col("_from"), F.col("block") * frames), F.least(F.col("_from") + F.col("_len"), (F.col("block") + 1) * frames)
    piece = F.struct(start.alias("at"), F.slice("samples", (start - F.col("_from") + 1).cast("int"), (end - start).cast("int")).alias("samples"))
    whole = cut.groupBy("session", "block").agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))
    blocks = whole.select("session", "block", F.flatten(F.transform("_pieces", lambda p: p["samples"])).alias("samples"))
    return blocks if rest else blocks.where(F.size("samples") == frames)
