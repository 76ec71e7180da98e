"""Queries over streams whose rows come late, out of order or twice, over their state, their sources and sinks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jstext, labels, prompt, question
from ..operators import answers, feed, ordered
from ..sources import folders, spool, wire
from ..streaming import asof, fold, ledger, ordering
from . import live
from .calls import _FULL, _LATE, _SAID, _SENT, _TIMED, folded
from .conversation import _ASKED, _ASKS, _classified
from .conversation import SQL as _TALK
from .inputs import full_log, speech_messages, sql, topic_changes, utterances

#: Days by which rows come out of order.
DELAY, DELAY_MS = "3 days", 3 * 86_400_000


def stream_topic_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the topic in force, where questions and changes come as two streams, out of order."""
    told = lambda df, text: df.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit("row").alias("kind"), text.alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    inputs = {"asked": told(question.gate(utterances(spark, sf_dir)), F.col("text")), "changes": told(topic_changes(spark, sf_dir), F.col("topic"))}
    folder = live.run(spark, "asof", inputs, lambda asked, changes: asof.as_of(asked, changes, DELAY), DELAY_MS)
    got = live.written(spark, folder, asof.OUT).where("not late")
    return got.select(F.col("seq").alias("event_id"), F.col("session").cast("long").alias("user_id"), "text", F.coalesce("value", F.lit(prompt.DEFAULT_TOPIC)).alias("topic"))


def stream_shuffled_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible items of a stream whose rows come out of order in several micro-batches."""
    folder = live.run(spark, "shuffled", {"log": full_log(spark, sf_dir)}, lambda log: fold.fold_in_order(log, DELAY), DELAY_MS)
    return fold.visible(live.written(spark, folder, fold.OUT))


def stream_redelivered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible items of a stream that brings every row twice, the second time with a later batch, and in order."""
    rows = folders.stored(full_log(spark, sf_dir))
    folder, n = folders.new(spark, "twice"), 2 * rows.count()
    lo, hi = rows.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    first = F.floor((F.col("ts_ms") - lo) / ((hi - lo) // 3 + 1)).cast("int")
    twice = rows.withColumn("_first", first).withColumn("_again", F.explode(F.array(F.lit(0), F.lit(1))))
    files = live.files(n, 4)
    live.deliver(twice, F.col("_first") + F.col("_again"), 4, f"{folder}/in", files)
    fold.to_files(fold.fold(ordering.once(live.events(live.session(spark, n), f"{folder}/in", number=files), "30 days")), f"{folder}/out", f"{folder}/at").awaitTermination()
    return fold.visible(live.written(spark, folder, fold.OUT))


def stream_open_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drafts that are open at the end of a stream, from its state."""
    got = fold.state(live.session(spark), f"{folded(spark, sf_dir)}/at")
    return got.where("draft <> ''").select("session", "draft")


def stream_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the view shows at the end of a stream, from its state: question, live transcript, status."""
    return fold.state(live.session(spark), f"{folded(spark, sf_dir)}/at").select("session", "question", "transcript", "status")


def spool_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of speech messages that come in through a spool as three epochs and go out through another; the stream
    stops after each epoch and starts again."""
    folder = folders.new(spark, "spool")
    spool.register(spark)
    rows = speech_messages(spark, sf_dir)
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).write.format("spool").mode("append").save(f"{folder}/in")
        said = wire.speech(spark.readStream.format("spool").schema("event_id long, message string").load(f"{folder}/in")).drop("message")
        said.writeStream.format("spool").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.format("spool").schema("event_id long, text string, is_final boolean").load(f"{folder}/out")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances with words as final transcripts of the event log."""
    text = jstext.trim(F.col("text"))
    return utterances(spark, sf_dir).where(text != "").select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.lit("final").alias("kind"), text.alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


def _requests(said: DataFrame) -> DataFrame:
    asked = question.gate(said)
    return asked.select("session", "seq", "ts_ms", F.lit(prompt.DEFAULT_TOPIC).alias("topic"), F.lit(prompt.DEFAULT_TEMPLATE).alias("template"), F.col("text").alias("question"))


def ledger_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of answers that a stream of transcripts asks for, batch by batch, and keeps in a ledger."""
    folder, said = folders.new(spark, "ledger"), folders.stored(_said(spark, sf_dir))
    batch, _ = live.shuffled(said, DELAY_MS, 3)
    files = live.files(said.count(), 3)
    live.deliver(said, batch, 3, f"{folder}/in", files)
    requests = _requests(live.events(live.session(spark), f"{folder}/in", number=files))
    ledger.to_ledger(requests, f"{folder}/answers", f"{folder}/at").awaitTermination()
    rows = answers.log(said, ledger.read(spark, f"{folder}/answers"), ["seq"])
    return feed.feed(rows, ["seq", "step"]).select(F.col("session").cast("long").alias("session"), F.col("seq").alias("event_id"), "question", "answer")


#: Milliseconds between pieces of an answer.
PACE = 6 * 3_600_000


def overlapping_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed where pieces of answers come so slowly that answers of one session mix: the first that is done takes what has
    come so far, and has the question that was last said then."""
    said = _said(spark, sf_dir)
    told = folders.stored(answers.told(_requests(said)))
    rows = answers.log(said, told.withColumn("ts_ms", F.col("ts_ms") + (F.col("chunk_idx") + 1) * PACE), ["ts_ms", "seq"])
    got = feed.feed(rows, ["ts_ms", "seq", "step"], ordered.by_number("ts_ms", 86_400_000))
    return got.select("session", F.col("seq").alias("event_id"), "question", "answer")


QUERIES = {f.__name__: f for f in (stream_topic_asof, stream_shuffled_feed, stream_redelivered_feed, stream_open_draft, stream_now, spool_transcripts, ledger_feed, overlapping_answers)}

_NOW = f"""{_FULL}, {_classified('v')},
t as (select session, seq, 1 as place, {_SAID} as text from v where kind in ('interim', 'final', 'error') and not {_LATE}
union all select session, seq, 1, '' from v where kind = 'clear'
union all select session, seq, 1, '{labels.CONNECTED}' from v where kind = 'start' and not active
union all select session, min(seq), 1, '{labels.FIRST_SOUND}' from v where kind = 'audio' and piped group by session, starts
union all select session, min(seq), 2, '{labels.FIRST_SENT}' from v where kind = 'audio' and active group by session, stops),
a as (select session, arg_max(text, (seq, place)) as transcript from t group by session),
s as (select session, arg_max({_SENT}, seq) filter (({_SENT}) is not null) as status from n2 group by session),
q as (select session, arg_max(text, seq) as question from v where kind = 'final' and not {_LATE} group by session)
select session, coalesce(question, '') as question, coalesce(transcript, '') as transcript, coalesce(status, 'idle') as status from s left join a using (session) left join q using (session)"""

_MIXED = f""", {_classified('utterances')},
r as (select user_id::varchar as session, event_id as seq, epoch_us(ts) // 1000 as ms, {_ASKS} as asks, trim(text) as text, list_prepend('You asked:', list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: ' ' || x)) as l from n2 where t <> ''),
e as (select session, ms, seq, -1 as step, 'final' as kind, text from r
union all select session, ms + (i + 1) * {PACE}, seq, i, case when i < len(l) then 'chunk' else 'done' end, l[i + 1] from (select *, unnest(range(0, len(l) + 1)) as i from r where asks)),
s as (select *, coalesce(sum((kind = 'done')::int) over (partition by session order by ms, seq, step rows between unbounded preceding and 1 preceding), 0) as seg, last_value(case when kind = 'final' then text end ignore nulls) over (partition by session order by ms, seq, step) as q from e),
g as (select session, seg, trim(string_agg(case when kind = 'chunk' then text end, '' order by ms, seq, step)) as answer, max(case when kind = 'done' then seq end) as event_id, max(case when kind = 'done' then q end) as question from s group by session, seg)
select session, event_id, question, answer from g where event_id is not null and answer <> ''"""

SQL = {
    "stream_topic_asof": sql(f", {_ASKED} select event_id, user_id, text, topic from a", "utterances", "topic_changes"),
    "stream_shuffled_feed": sql(_TIMED, "full_log"),
    "stream_redelivered_feed": sql(_TIMED, "full_log"),
    "stream_open_draft": sql(", e as (select session, max(seq) as at from full_log where kind in ('done', 'clear') group by session) select full_log.session, string_agg(text, '' order by seq) as draft from full_log left join e using (session) where kind = 'chunk' and (e.at is null or seq > e.at) group by full_log.session", "full_log"),
    "stream_now": sql(_NOW, "full_log"),
    "spool_transcripts": sql(", m as (select event_id, trim(coalesce(json_extract_string(message, '$.channel.alternatives[0].transcript'), '')) as text, coalesce(json_extract_string(message, '$.is_final') = 'true', false) as is_final from speech_messages where json_extract_string(message, '$.type') = 'Results') select * from m where text <> ''", "speech_messages"),
    "ledger_feed": _TALK["answered_feed"],
    "overlapping_answers": sql(_MIXED, "utterances"),
}
