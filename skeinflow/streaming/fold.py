"""The fold of a session's events as a stream: state by session in the state store, items and statuses as they come.

Each micro-batch is folded in order of `seq`. Where rows come in any order, `fold_in_order` holds them until the watermark
has passed them. A `clear` can't take back items that a sink has, so it is written as a row of its own; `visible` leaves out what it hides."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import jstext, labels, question
from ..sources import wire
from . import ordering

STATE = "question STRING, draft STRING, active BOOLEAN, piped BOOLEAN, apart BOOLEAN, closed BOOLEAN, sound BOOLEAN, sent BOOLEAN, transcript STRING, status STRING"
OUT = "session STRING, seq BIGINT, kind STRING, text STRING, question STRING, answer STRING, ts_ms BIGINT"
#: Kinds that every window gets; the overlay alone gets statuses.
SHARED = ("interim", "final", "chunk", "done")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


START = ("", "", False, False, False, False, False, False, "", "idle")


def run(value: tuple, session: str, rows: Iterable[Row]) -> tuple[tuple, list[Row]]:
    """The session's value after rows in order, and rows out, with the time of the event that makes them: `interim` and `final`
    transcripts, errors and what is said of the audio being interim ones, `chunk` and `done` of answers, `status`, all with
    `text`; `item` (question, answer); `clear`. Switches are as in `operators.status`: late results of a closed
    connection are lost."""
    asked, draft, active, piped, apart, closed, sound, sent, transcript, status = value
    out = []

    def tell(r: Row, kind: str, text: str | None = None, question: str | None = None, answer: str | None = None) -> None:
        nonlocal transcript, status
        if kind in ("interim", "final", "clear"):
            transcript = text or ""
        elif kind == "status":
            status = text
        out.append(Row(session=session, seq=r.seq, kind=kind, text=text, question=question, answer=answer, ts_ms=r.ts_ms))

    for r in rows:
        text = r.text or ""
        if r.kind in ("interim", "final", "error"):
            if closed and not (active or apart):
                continue
            if r.kind == "error":
                prefix, unknown = labels.FALLBACKS["stt"]
                tell(r, "interim", prefix + (unknown if r.text is None else r.text))
            else:
                tell(r, r.kind, text)
            if r.kind == "final":
                asked = text
            if active or apart:
                if r.kind == "error":
                    tell(r, "status", "error")
                elif r.kind == "final" and r.is_question:
                    tell(r, "status", "answering")
        elif r.kind == "chunk":
            draft += text
            tell(r, "chunk", text)
        elif r.kind == "done":
            tell(r, "done")
            answer = draft.strip(jstext.WHITE)
            if asked and answer:
                tell(r, "item", None, asked, answer)
            draft = ""
            tell(r, "status", "capturing")
        elif r.kind == "clear":
            draft = ""
            tell(r, "clear")
        elif r.kind == "start":
            if not active:
                tell(r, "status", "capturing")
                tell(r, "interim", labels.CONNECTED)
            active, piped, closed, sound = True, True, False, False
        elif r.kind in ("stop", "failed"):
            if active:
                tell(r, "status", "idle")
            active, closed, sent = False, True, False
        elif r.kind == "keys":
            apart = apart or active
            active, piped, sent = False, False, False
        elif r.kind == "audio" and piped and r.text is not None:
            if not sound:
                sound = True
                tell(r, "interim", labels.FIRST_SOUND)
            if active and not sent:
                sent = True
                tell(r, "interim", labels.FIRST_SENT)
    return (asked, draft, active, piped, apart, closed, sound, sent, transcript, status), out


def late(session: str, r: Row) -> Row:
    """The row told of one that comes too late to be folded in."""
    return Row(session=session, seq=r.seq, kind="late", text=r.text, question=None, answer=None, ts_ms=r.ts_ms)


#: The fold as a step of `ordering.in_order`.
STEP = ordering.Step(STATE, START, run, late, OUT, "kind STRING, text STRING, is_question BOOLEAN")


class Fold(StatefulProcessor):
    """Folds what comes at once in order of `seq`. Rows whose number is no larger than one folded in before are `late`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", f"{STATE}, last BIGINT")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        *value, last = tuple(self.state.get()) if self.state.exists() else (*START, None)
        fit, out = [], []
        for r in sorted(ordering.named(rows, STEP.names), key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                out.append(late(key[0], r))
            else:
                fit.append(r)
                last = r.seq
        value, told = run(tuple(value), key[0], fit)
        self.state.update((*value, last))
        yield from out
        yield from told

    def close(self) -> None:
        pass


def _classified(log: DataFrame) -> DataFrame:
    """Questions are told apart before the shuffle, in the JVM."""
    return question.classified(log.where("session is not null and seq is not null").select("session", "seq", "kind", "text", "ts_ms")).drop("words", "reason")


def fold(log: DataFrame) -> DataFrame:
    """Transcripts, pieces of answers, items, clears and statuses of a streamed event log (session, seq, kind, text,
    ts_ms) whose numbers rise from batch to batch; rows that fall back come out as `late`. The session's store must be
    RocksDB: see PROVIDER."""
    return _classified(log).groupBy("session").transformWithState(Fold(), OUT, "Append", "None")


def fold_in_order(log: DataFrame, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """The same of a log whose rows come in any order, up to `delay` behind the latest time; later ones come out as `late`.
    A session's state goes after `idle_ms` without rows."""
    return ordering.in_order(_classified(log), STEP, delay, idle_ms)


def shared(rows: DataFrame) -> DataFrame:
    """What every window gets: transcripts, chunks and ends of answers."""
    return rows.where(F.col("kind").isin(*SHARED)).select("session", "seq", "kind", "text", "ts_ms")


def statuses(rows: DataFrame) -> DataFrame:
    """What the overlay gets besides."""
    return rows.where("kind = 'status'").select("session", "seq", F.col("text").alias("status"), "ts_ms")


def now(written: DataFrame) -> DataFrame:
    """session, transcript, status from what a sink has: the last of each, empty after a clear, and `idle` before any."""
    last = lambda *kinds: F.max_by(F.when(F.col("kind") == "clear", "").otherwise(F.col("text")), F.when(F.col("kind").isin(*kinds), F.col("seq")))
    got = written.groupBy("session").agg(last("interim", "final", "clear").alias("transcript"), last("status").alias("status"))
    return got.select("session", F.coalesce("transcript", F.lit("")).alias("transcript"), F.coalesce("status", F.lit("idle")).alias("status"))


def visible(written: DataFrame) -> DataFrame:
    """session, seq, question, answer of the items that no later `clear` hides, from what a sink has."""
    clears = written.where("kind = 'clear'").groupBy("session").agg(F.max("seq").alias("_clear"))
    items = written.where("kind = 'item'").join(clears, "session", "left")
    return items.where(F.col("_clear").isNull() | (F.col("seq") > F.col("_clear"))).select("session", "seq", "question", "answer", F.col("ts_ms").alias("created_ms"))


def state(spark: SparkSession, checkpoint: str, in_order: bool = False) -> DataFrame:
    """session, question, draft, transcript, status, active from the state of a fold with this checkpoint: what the view would
    show now, the draft that is open included, which no sink has. in_order: of `fold_in_order`."""
    rows = spark.read.format("statestore").option("stateVarName", "value" if in_order else "session").load(checkpoint)
    return rows.select("key.session", *[F.col(f"value.{c}").alias(c) for c in ("question", "draft", "transcript", "status", "active")])


def transcripts(messages: DataFrame) -> DataFrame:
    """Transcripts of a stream of speech messages: stateless."""
    return wire.speech(messages)


def to_sinks(rows: DataFrame, sinks: Sequence[Callable[[DataFrame], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Sends each micro-batch to every sink, as a broadcast does. A batch that is run again after a loss reaches
    the sinks again: they must write by key or ignore what they have."""

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def to_windows(rows: DataFrame, overlay: Callable[[DataFrame], None], others: Sequence[Callable[[DataFrame], None]], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Sends the rows of `fold` to the overlay, and all but statuses, items and clears to the other windows."""
    return to_sinks(rows, [overlay, *[lambda batch, sink=sink: sink(shared(batch)) for sink in others]], checkpoint, once)


def to_files(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet files, each row once."""
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
