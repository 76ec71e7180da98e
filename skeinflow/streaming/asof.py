"""The topic in force when a question is asked, where changes of the topic and questions come as streams.

A session's topic is a value of its state. Questions wait, with changes, until the watermark has passed them, so that a
change that comes after a question but was made before it still counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import ordering

OUT = "session STRING, seq BIGINT, text STRING, value STRING, ts_ms BIGINT, late BOOLEAN"


def run(value: tuple, session: str, rows: Iterable[Row]) -> tuple[tuple, list[Row]]:
    (now,), out = value, []
    for r in rows:
        if r.kind == "change":
            now = r.text
        else:
            out.append(Row(session=session, seq=r.seq, text=r.text, value=now, ts_ms=r.ts_ms, late=False))
    return (now,), out


def late(session: str, r: Row) -> Row:
    return Row(session=session, seq=r.seq, text=r.text, value=None, ts_ms=r.ts_ms, late=True)


STEP = ordering.Step("value STRING", (None,), run, late, OUT)


def as_of(rows: DataFrame, changes: DataFrame, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """Rows (session, seq, text, value, ts_ms, late) of the streams `rows` and `changes`, both (session, seq, text, ts_ms): each
    of `rows` with the text of the session's last change before it; null where there is none. Of a change and a row of one
    number the change comes first. Rows, and changes, that come more than `delay` behind the latest time are `late`:
    a late row has no value, a late change counts for nothing."""
    told = lambda df, kind, at: df.select("session", (2 * F.col("seq") + at).alias("seq"), "ts_ms", F.lit(kind).alias("kind"), "text")
    got = ordering.in_order_all([told(changes, "change", 0), told(rows, "row", 1)], STEP, delay, idle_ms)
    return got.withColumn("seq", F.floor(F.col("seq") / 2))
