"""Queries over calls that fail, lose their keys or end early, over streams, sources and stored settings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio, labels, prompt, settings
from ..operators import feed, ordered, status
from ..sources import folders, wire
from ..streaming import fold
from . import live
from .conversation import _ASKS, _LABEL, _classified
from .inputs import ORDER, blocks, call_log, full_log, speech_messages, sql, table


def _hour():
    return ordered.by_hour("ts")


def keys_detach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of calls whose keys are saved meanwhile: the open connection goes on, a stop says nothing."""
    return status.timeline(call_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id", "status")


def start_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How calls end, failed starts among them."""
    return status.last_status(call_log(spark, sf_dir), ORDER, _hour())


def late_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of the speech service that aren't late."""
    rows = status.heard(call_log(spark, sf_dir), ORDER, _hour())
    return rows.where(F.col("kind").isin(*status.RESULTS)).select("session", "event_id", "kind")


def heard_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live transcript without late results; interim ones and errors count."""
    return feed.live_transcript(status.heard(call_log(spark, sf_dir), ORDER, _hour()), ORDER)


def detached_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio chunks that reach the speech service, where keys are saved meanwhile."""
    return status.audio_kept(call_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id")


def detached_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.audio_counts(call_log(spark, sf_dir), ORDER, _hour())


def sound_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples read from chunks of bytes; every fifth chunk is empty and every seventh null."""
    n = F.col("vec_id")
    data = F.when(n % 7 == 0, None).when(n % 5 == 0, F.lit("").cast("binary")).otherwise(audio.to_bytes(audio.capture(F.col("samples"))))
    rows = wire.sound(blocks(spark, sf_dir).select("vec_id", data.alias("data")))
    return rows.select("vec_id", F.posexplode("samples").alias("pos", "sample")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def first_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of blocks of two channels, of which the first counts; every fifth block has none."""
    still = F.transform("samples", lambda x: F.lit(0).cast("float"))
    channels = F.when(F.col("vec_id") % 5 == 0, F.array().cast("array<array<float>>")).otherwise(F.array("samples", still))
    rows = wire.blocks(blocks(spark, sf_dir).select("vec_id", channels.alias("channels")))
    return rows.select("vec_id", F.posexplode("pcm").alias("pos", "sample")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def audio_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio tracks of sources that have one, and some of them pictures too."""
    kind = F.col("event_type")
    tracks = table(spark, sf_dir, "events").select(F.col("event_id").alias("source"), F.explode(F.when(kind == "view", F.array(F.lit("video"), F.lit("audio"))).otherwise(F.array(F.lit("audio")))).alias("track"))
    return wire.with_audio_track(tracks).select("source", "track")


def stored_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of an installation for each customer: read, changed, stored with keys encrypted, and read again; keys that are
    empty come from the environment, other missing fields from the defaults."""
    folder, key, n = folders.new(spark, "settings"), "0123456789abcdef", F.col("c_custkey")
    window = F.struct(*[F.when(n % (i + 2) == 0, F.col("c_acctbal") + i).alias(f) for i, f in enumerate(settings.OVERLAY)])
    some = lambda k, text: F.when(n % k != 0, F.concat(F.lit(text), n.cast("string"))).otherwise("")
    own = table(spark, sf_dir, "customer").select(F.col("c_name").alias("topic"), F.when(n % 2 == 0, F.col("c_mktsegment")).alias("topicPromptTemplate"), settings.merged(F.struct(*[F.lit(v).alias(f) for f, v in settings.OVERLAY.items()]), window).alias("overlay"), some(3, "s").alias("deepgramApiKey"), some(4, "a").alias("openAiApiKey"))
    own.write.json(f"{folder}/first")
    read = wire.read_settings(spark, f"{folder}/first", environment={}, lines=True)
    wire.write_settings(wire.update_overlay(read, x=7.0, opacity=0.5), f"{folder}/second", key)
    got = wire.read_settings(spark, f"{folder}/second", key, {"OPENAI_API_KEY": "from outside", "DEEPGRAM_API_KEY": ""}, lines=True)
    return got.select("topic", "topicPromptTemplate", "overlay.*", "apiKeys.*")


def speech_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of speech messages that come as a stream of lines, counted."""
    folder = folders.new(spark, "speech")
    speech_messages(spark, sf_dir).select("message").write.text(f"{folder}/in")
    query = fold.to_files(fold.transcripts(wire.messages(spark, f"{folder}/in", streaming=True)), f"{folder}/out", f"{folder}/at")
    query.awaitTermination()
    return spark.read.schema("text string, is_final boolean").parquet(f"{folder}/out").groupBy("text", "is_final").agg(F.count("*").alias("n"))


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fold of the full log, read as a stream, writes."""
    return live.written(spark, folded(spark, sf_dir), fold.OUT)


def folded(spark: SparkSession, sf_dir: str) -> str:
    """The folder of a fold of the full log, read as a stream."""
    folder = folders.new(spark, "fold")
    full_log(spark, sf_dir).write.json(f"{folder}/in")
    fold.to_files(fold.fold(wire.events(live.session(spark), f"{folder}/in", streaming=True)), f"{folder}/out", f"{folder}/at").awaitTermination()
    return folder


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the windows get: transcripts, chunks and ends of answers, and for the overlay statuses, with their times."""
    rows = _folded(spark, sf_dir)
    return fold.shared(rows).unionByName(fold.statuses(rows).select("session", "seq", F.lit("status").alias("kind"), F.col("status").alias("text"), "ts_ms"))


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible items of the stream, with their times."""
    return fold.visible(_folded(spark, sf_dir))


def timed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in batch, without late results."""
    got = feed.feed(status.heard(full_log(spark, sf_dir)), stamp="ts_ms")
    return got.select("session", "seq", "question", "answer", F.col("ts_ms").alias("created_ms"))


QUERIES = {f.__name__: f for f in (keys_detach, start_failed, late_results, heard_transcript, detached_audio, detached_counter, sound_bytes, first_channel, audio_track, stored_settings, speech_stream, stream_windows, stream_feed, timed_feed)}


def _switched(log: str, order: str) -> str:
    """What is known of the session before each event of a log."""
    before = f"over (partition by session order by {order} rows between unbounded preceding and 1 preceding)"
    last = lambda *kinds: f"last_value(case when kind in {kinds!r} then kind end ignore nulls) {before}"
    count = lambda *kinds: f"coalesce(sum((kind in ({', '.join(map(repr, kinds))}))::int) {before}, 0)::bigint"
    return f"""v0 as (select *, {last('start', 'stop', 'failed', 'keys')} as sw, {last('start', 'stop', 'failed')} as ask, {last('start', 'keys')} as pipe, {count('start')} as starts, {count('stop', 'failed', 'keys')} as stops from {log}),
f as (select session as s, min(({order})) as f from v0 where kind = 'keys' and sw = 'start' group by session),
v as (select *, coalesce(sw = 'start', false) as active, coalesce(sw = 'start', false) or coalesce(({order}) > f, false) as open, coalesce(ask in ('stop', 'failed'), false) as closed, coalesce(pipe = 'start', false) as piped from v0 left join f on session = s)"""


_LATE = "(kind in ('interim', 'final', 'error') and closed and not open)"
_SENT = f"case when kind = 'start' and not active then 'capturing' when kind in ('stop', 'failed') and active then 'idle' when kind = 'final' and open and {_ASKS} then 'answering' when kind = 'error' and open then 'error' when kind = 'done' then 'capturing' end"
_OWN = f"coalesce(case when kind = 'failed' then 'error' when kind = 'stop' and starts > 0 and not closed then 'idle' when kind = 'start' and (starts = 0 or closed) then 'capturing' end, {_SENT})"
_CALLS = ", " + _switched("call_log", "ts, event_id")
_FULL = ", " + _switched("full_log", "seq")
_PCM = "p as (select vec_id, i, ((samples[3 * i + 1]::double + samples[3 * i + 2]::double + samples[3 * i + 3]::double) / 3) as m from (select vec_id, samples, unnest(range(0, len(samples) // 3)) as i from blocks)), c as (select vec_id, i, greatest(-1, least(1, m)) as c from p), q as (select vec_id, i as pos, trunc(case when c < 0 then c * 32768 else c * 32767 end)::bigint as sample from c)"
_SAID = "case kind when 'error' then 'STT error: ' else '' end || text"
_TIMED = f"""{_FULL}, k as (select * from v where not {_LATE} and kind in ('final', 'chunk', 'done', 'clear')),
s as (select *, coalesce(sum((kind in ('done', 'clear'))::int) over (partition by session order by seq rows between unbounded preceding and 1 preceding), 0) as seg, last_value(case when kind = 'final' then text end ignore nulls) over (partition by session order by seq) as q from k),
g as (select session, seg, trim(coalesce(string_agg(case when kind = 'chunk' then text end, '' order by seq), '')) as answer, max(case when kind = 'done' then seq end) as seq, max(case when kind = 'done' then ts_ms end) as created_ms, max(case when kind = 'done' then q end) as question from s group by session, seg),
l as (select session, max(seq) as hid from full_log where kind = 'clear' group by session)
select g.session, g.seq, question, answer, created_ms from g left join l using (session) where g.seq is not null and question <> '' and answer <> '' and (hid is null or g.seq > hid)"""

SQL = {
    "keys_detach": sql(f"{_CALLS}, {_classified('v')}, z as (select session, event_id, {_SENT} as status from n2) select * from z where status is not null", "control_log", "call_log"),
    "start_failed": sql(f"{_CALLS}, {_classified('v')}, z as (select *, {_OWN} as o from n2), e as (select session, coalesce(arg_max(o, (ts, event_id)) filter (o is not null), 'idle') as status, coalesce(arg_max(kind, (ts, event_id)) filter (kind in ('start', 'stop', 'failed')) = 'start', false) as running from z group by session) select session, status, running, {_LABEL} as label from e", "control_log", "call_log"),
    "late_results": sql(f"{_CALLS} select session, event_id, kind from v where kind in ('interim', 'final', 'error') and not {_LATE}", "control_log", "call_log"),
    "heard_transcript": sql(f"{_CALLS} select session, coalesce(arg_max(case when kind = 'error' then '{labels.FALLBACKS['stt'][0]}' || coalesce(text, '{labels.FALLBACKS['stt'][1]}') else coalesce(text, '') end, (ts, event_id)), '') as transcript from v where kind in ('interim', 'final', 'error') and not {_LATE} group by session", "control_log", "call_log"),
    "detached_audio": sql(f"{_CALLS} select session, event_id from v where kind = 'audio' and active and text is not null", "control_log", "call_log"),
    "detached_counter": sql(f"{_CALLS} select session, starts, count(*) as chunks from v where kind = 'audio' and piped and text is not null group by session, starts", "control_log", "call_log"),
    "sound_bytes": sql(f", {_PCM} select * from q where vec_id % 7 <> 0 and vec_id % 5 <> 0", "blocks"),
    "first_channel": sql(f", {_PCM} select * from q where vec_id % 5 <> 0", "blocks"),
    "audio_track": "select event_id as source, 'audio' as track from events",
    "stored_settings": "select c_name as topic, case when c_custkey % 2 = 0 then c_mktsegment else '" + prompt.DEFAULT_TEMPLATE.replace("'", "''") + "' end as topicPromptTemplate, 7::double as x, case when c_custkey % 3 = 0 then c_acctbal + 1 else 40 end as y, case when c_custkey % 4 = 0 then c_acctbal + 2 else 540 end as width, case when c_custkey % 5 = 0 then c_acctbal + 3 else 420 end as height, 0.5::double as opacity, case when c_custkey % 3 <> 0 then 's' || c_custkey else '' end as deepgramApiKey, case when c_custkey % 4 <> 0 then 'a' || c_custkey else 'from outside' end as openAiApiKey from customer",
    "speech_stream": sql(", m as (select trim(coalesce(json_extract_string(message, '$.channel.alternatives[0].transcript'), '')) as text, coalesce(json_extract_string(message, '$.is_final') = 'true', false) as is_final from speech_messages where json_extract_string(message, '$.type') = 'Results') select text, is_final, count(*) as n from m where text <> '' group by all", "speech_messages"),
    "stream_windows": sql(
        f"""{_FULL}, {_classified('v')},
w as (select session, seq, case kind when 'error' then 'interim' else kind end as kind, {_SAID} as text, ts_ms from v where kind in ('interim', 'final', 'error') and not {_LATE}
union all select session, seq, kind, text, ts_ms from v where kind in ('chunk', 'done')
union all select session, seq, 'interim', '{labels.CONNECTED}', ts_ms from v where kind = 'start' and not active
union all select session, min(seq), 'interim', '{labels.FIRST_SOUND}', arg_min(ts_ms, seq) from v where kind = 'audio' and piped group by session, starts
union all select session, min(seq), 'interim', '{labels.FIRST_SENT}', arg_min(ts_ms, seq) from v where kind = 'audio' and active group by session, stops
union all select session, seq, 'status', {_SENT}, ts_ms from n2 where ({_SENT}) is not null) select * from w""",
        "full_log",
    ),
    "stream_feed": sql(_TIMED, "full_log"),
    "timed_feed": sql(_TIMED, "full_log"),
}
