"""The fold of a session's events: live transcript, question, draft answer, question and answer feed.

An event log has session, kind, text and one or more order columns. Kinds: `interim` and `final` transcripts,
`chunk` of an answer, `done` (the answer is complete), `clear` (the user empties the view). Chunks carry no
question: an answer belongs to the final transcript that is the last one when its `done` comes, and answers
that run at the same time mix in one draft. `clear` hides earlier items and drops the draft, not the question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import jstext, labels
from .ordered import by_number, running


def _text(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.coalesce(F.col("text"), F.lit("")))


def _closes() -> Column:
    return F.col("kind").isin("done", "clear")


def segments(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None, stamp: str | None = None) -> DataFrame:
    """The log, and its column `stamp`, with `segment`, the number of earlier `done` and `clear` events of the session, `segment_total`,
    `clears`, `clears_total`, and `question`, the last final transcript so far."""
    block = by_number(order[0]) if block is None else block
    known = log.where(F.col("kind").isin("final", "chunk", "done", "clear")).select("session", "kind", "text", *order, *[c for c in [stamp] if c and c not in order])
    return running(known, ["session"], order, block, counts={"segment": _closes(), "clears": F.col("kind") == "clear"}, lasts={"question": _text("final")})


def _draft(order: Sequence[str]) -> Column:
    return F.expr(f"coalesce(listagg(case when kind = 'chunk' then text end, '') within group (order by {', '.join(order)}), '')")


def items(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None, stamp: str | None = None) -> DataFrame:
    """All questions with their answers, also those that a later `clear` hides: session, the order columns of the
    `done` event and its `stamp`, the time that its source gave it, question, answer, visible. Blank answers and
    answers without a question are none.

    Only drafts that a `done` or `clear` ends are put together: one that stays open is no item."""
    rows = segments(log, order, block, stamp).where("kind <> 'final'").where("segment < segment_total")
    order_ = [*order, *[c for c in [stamp] if c and c not in order]]
    end = lambda c: F.max(F.when(F.col("kind") == "done", F.col(c))).alias(c)  # noqa: E731  one event ends a segment
    drafts = rows.groupBy("session", "segment").agg(_draft(order).alias("draft"), *[end(c) for c in (*order_, "question", "clears", "clears_total")])
    done = drafts.where(F.col(order[0]).isNotNull()).withColumn("answer", jstext.trim(F.col("draft")))
    kept = done.where("question <> '' and answer <> ''")
    return kept.select("session", *order_, "question", "answer", (F.col("clears") == F.col("clears_total")).alias("visible"))


def feed(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None, stamp: str | None = None) -> DataFrame:
    """The items that the user sees; newest first is by descending order columns. A log with late results goes
    through `status.heard` first."""
    return items(log, order, block, stamp).where("visible").drop("visible")


def newest_first(shown: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Items in the order of the view."""
    return shown.orderBy("session", *[F.desc(c) for c in order])


def placed(shown: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """Items with `place`, their number in the session's view, 1 for the newest. No task holds a session."""
    got = running(shown, ["session"], order, by_number(order[0]) if block is None else block, counts={"_older": F.lit(True)})
    return got.withColumn("place", F.col("_older_total") - F.col("_older")).drop("_older", "_older_total")


def newest(shown: DataFrame, k: int, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """The k newest items of each session, with `place`, 1 for the newest. A block gives up all but its k newest before
    blocks meet, and so does each task before the shuffle: no session is sorted or gathered. Rows with a null session or
    order are dropped."""
    rows = shown.withColumn("_block", by_number(order[0]) if block is None else block)
    for c in ("session", *order):
        rows = rows.where(F.col(c).isNotNull())
    for key in (["session", "_block"], ["session"]):
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order]))).where(F.col("place") <= k)
    return rows.drop("_block")


def _last(log: DataFrame, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    placed = log.where(F.col("kind").isin(*kinds))
    for c in ("session", *order):
        placed = placed.where(F.col(c).isNotNull())
    return placed.groupBy("session").agg(F.max_by(F.struct("kind", F.coalesce(F.col("text"), F.lit("")).alias("text")), F.struct(*order)).alias("_e"))


def live_transcript(log: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """session, transcript: the last transcript of any kind, errors of the speech service being some, empty after
    `clear`. A log with late results goes through `status.heard` first."""
    said = log.withColumn("text", F.when(F.col("kind") == "error", labels.failure("stt", F.col("text"))).otherwise(F.col("text")))
    got = _last(said, order, ("interim", "final", "error", "clear"))
    return got.select("session", F.when(F.col("_e.kind") == "clear", "").otherwise(F.col("_e.text")).alias("transcript"))


def current_question(log: DataFrame, order: Sequence[str] = ("seq",)) -> DataFrame:
    """session, question: the last final transcript; `clear` doesn't change it."""
    return _last(log, order, ("final",)).select("session", F.col("_e.text").alias("question"))


def open_draft(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """session, draft: the chunks since the last `done` or `clear`, where there are some."""
    rows = segments(log, order, block).where("kind = 'chunk' and segment = segment_total")
    return rows.groupBy("session").agg(_draft(order).alias("draft")).where("draft <> ''")
