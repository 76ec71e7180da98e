"""The status of sessions, and what is said of their audio.

Kinds of the log: `start` and `stop` as the user asks for them, `failed` where a start fails (the user's side then
stops), `keys` where new keys are saved (the pipeline is dropped without a stop: its connection stays open, but gets no
audio and no stop), `interim` and `final` transcripts, `done`, `error` of the speech service, `audio` chunks (a null
text is an empty chunk). A session is active from a start to the next stop, failed start or saving of keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels, question
from .ordered import by_number, running

#: Kinds that switch a session on or off.
SWITCHES = ("start", "stop", "failed", "keys")
#: Kinds that come from the speech service.
RESULTS = ("interim", "final", "error")


def activity(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """The log with, before each event: `active`; `piped`, whether there is a pipeline, be it stopped; `open`, whether a
    connection is, be it one whose pipeline was dropped; `closed`, whether the last switch but for saved keys was off;
    `starts`, start calls so far; `stops`, switches off so far."""
    block = by_number(order[0]) if block is None else block
    kind = F.col("kind")
    # Where keys are saved while a session is active its pipeline is dropped: found among the few switches, and put into the
    # log as rows of their own, so that the log is carried along once and no session is joined as a whole.
    switches = running(log.where(kind.isin(*SWITCHES)).select("session", "kind", *order), ["session"], order, block, before={"_before": kind})
    dropped = switches.where("kind = 'keys' and _before = 'start'").select("session", *order, F.lit(1).alias("_mark"))
    both = log.withColumn("_mark", F.lit(0)).unionByName(dropped, allowMissingColumns=True)
    got = running(
        both,
        ["session"],
        [*order, "_mark"],
        block,
        counts={"starts": kind == "start", "stops": kind.isin("stop", "failed", "keys")},
        before={"_switch": F.when(kind.isin(*SWITCHES), kind), "_asked": F.when(kind.isin("start", "stop", "failed"), kind), "_pipe": F.when(kind.isin("start", "keys"), kind), "_apart": F.when(F.col("_mark") == 1, True)},
    )
    got = got.where("_mark = 0")
    on = lambda c: F.coalesce(F.col(c) == "start", F.lit(False))
    got = got.withColumns({"active": on("_switch"), "piped": on("_pipe")})
    closed = F.coalesce(F.col("_asked").isin("stop", "failed"), F.lit(False))
    return got.withColumns({"open": F.col("active") | F.coalesce("_apart", F.lit(False)), "closed": closed}).drop("starts_total", "stops_total", "_switch", "_asked", "_pipe", "_apart", "_mark")


def heard(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """The log without late results: what the speech service sends after a stop or a failed start is lost, unless a
    connection is still open. A session whose log tells of no switch is one of results alone and stays whole."""
    rows = activity(log, order, block)
    return rows.where(~(F.col("kind").isin(*RESULTS) & F.col("closed") & ~F.col("open"))).select(*log.columns)


def timeline(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """session, the order columns and status, one row for each status that is sent.

    Starting an active session and stopping an inactive one send nothing; transcripts and errors without an open
    connection are lost. An answer that is done sends `capturing`, also after a stop. A failed start stops a session
    that is active; saving keys sends nothing, and a stop after it sends nothing either."""
    rows = question.classified(activity(log.select("session", "kind", "text", *order), order, block))
    return rows.withColumn("status", _sent()).where("status is not null").select("session", *order, "status")


def _sent() -> Column:
    kind, active, open_ = F.col("kind"), F.col("active"), F.col("open")
    return (
        F.when((kind == "start") & ~active, "capturing")
        .when(kind.isin("stop", "failed") & active, "idle")
        .when((kind == "final") & open_ & F.col("is_question"), "answering")
        .when((kind == "error") & open_, "error")
        .when(kind == "done", "capturing")
    )


def last_status(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """session, status, running and label: how each session ends in the user's view, `idle` before any status.

    The view also sets statuses itself: `capturing` when a start succeeds while it isn't running, `idle` at its stop,
    and `error` when a start fails, after which it isn't running."""
    place = F.struct(*order)
    rows = question.classified(activity(log.select("session", "kind", "text", *order), order, block))
    kind = F.col("kind")
    own = F.when(kind == "failed", "error").when((kind == "stop") & (F.col("starts") > 0) & ~F.col("closed"), "idle").when((kind == "start") & ((F.col("starts") == 0) | F.col("closed")), "capturing")
    shown = rows.withColumn("_own", F.coalesce(own, _sent()))
    ends = shown.groupBy("session").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), place)).alias("_status"), F.max_by("kind", F.when(kind.isin("start", "stop", "failed"), place)).alias("_switch"))
    running_ = F.coalesce(F.col("_switch") == "start", F.lit(False))
    status = F.coalesce("_status", F.lit("idle"))
    return ends.select("session", status.alias("status"), running_.alias("running"), labels.status_label(running_, status).alias("label"))


def audio_kept(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """The audio chunks of active sessions; those before a start, after a stop or after keys were saved are dropped."""
    rows = activity(log, order, block)
    return rows.where("kind = 'audio' and active and text is not null").select(*log.columns)


def audio_counts(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """session, starts, chunks: chunks that are not empty since each start call, also of an inactive session, while
    there is a pipeline."""
    rows = activity(log, order, block)
    return rows.where("kind = 'audio' and text is not null and piped").groupBy("session", "starts").agg(F.count("*").alias("chunks"))


def diagnostics(log: DataFrame, order: Sequence[str] = ("seq",), block: Column | None = None) -> DataFrame:
    """session, the order columns and text: interim transcripts about the connection and the first chunks. The first
    chunk of a group is a minimum, so that no group is gathered."""
    rows = activity(log, order, block)
    place = F.min(F.struct(*order)).alias("_p")
    sound = rows.where("kind = 'audio' and text is not null")
    heard = sound.where("piped").groupBy("session", "starts").agg(place).select("session", "_p.*", F.lit(labels.FIRST_SOUND).alias("text"))
    sent = sound.where("active").groupBy("session", "stops").agg(place).select("session", "_p.*", F.lit(labels.FIRST_SENT).alias("text"))
    connected = rows.where("kind = 'start' and not active").select("session", *order, F.lit(labels.CONNECTED).alias("text"))
    return heard.unionByName(sent).unionByName(connected)
