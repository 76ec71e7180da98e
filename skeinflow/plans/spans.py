"""Queries over blocks of sound, spans of time, sessions, newest items and latencies, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..operators import blocking, feed, intervals, latency, ordered, status
from ..streaming import blocking as stream_blocking
from . import live
from .conversation import _ITEMS, _TIMELINE
from .inputs import ORDER, blocks, control_log, event_log, full_log, sql, topic_changes
from .streams import DELAY, DELAY_MS

HOUR_MS, DAY_US = 3_600_000, 86_400_000_000
#: Milliseconds without an event that end a session.
GAP = 12 * HOUR_MS


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as runs of 0 to 64 samples of two sessions."""
    n = F.col("vec_id")
    return blocks(spark, sf_dir).select((n % 2).cast("string").alias("session"), n.alias("seq"), F.slice("samples", 1, (n % 65).cast("int")).alias("samples"), (n * 1000).alias("ts_ms"))


def _pcm(packed: DataFrame) -> DataFrame:
    rows = packed.select("session", "block", F.posexplode(audio.capture(F.col("samples"))).alias("pos", "sample"))
    return rows.select("session", "block", F.col("pos").cast("long").alias("pos"), F.col("sample").cast("long").alias("sample"))


def packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs laid end to end, packed into blocks and resampled block by block."""
    return _pcm(blocking.packed(_runs(spark, sf_dir)))


def stream_packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream whose runs come out of order."""
    folder = live.run(spark, "packed", {"runs": _runs(spark, sf_dir)}, lambda runs: stream_blocking.packed(runs, delay="60 seconds"), 60_000, schema=stream_blocking.RUNS)
    return _pcm(live.written(spark, folder, stream_blocking.OUT).where("not late").select("session", "block", "samples"))


def audio_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio chunks that come while a question is being answered, with the event that ends the answer."""
    log = control_log(spark, sf_dir)
    told = status.timeline(log, ORDER, ordered.by_hour("ts"))
    before = ordered.running(told, ["session"], ORDER, ordered.by_hour("ts"), before={"_was": F.struct("status", "ts")})
    at = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    spans = before.where("status = 'capturing' and _was.status = 'answering'").select("session", at("_was.ts").alias("since"), at("ts").alias("until"), F.col("event_id").alias("ended"))
    sound = log.where("kind = 'audio' and text is not null").select("session", "event_id", at("ts").alias("at"))
    return intervals.inside(sound, spans, ["session"], "at", "since", "until", DAY_US).select("session", "event_id", "ended")


def talk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of a session's events without a gap of twelve hours."""
    got = intervals.sessions(full_log(spark, sf_dir), ["session"], "ts_ms", GAP, ["ts_ms", "seq"], ordered.by_number("ts_ms", 24 * HOUR_MS))
    return got.select("session", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


def stream_talk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a stream whose events come out of order."""
    folder = live.run(spark, "sessions", {"log": full_log(spark, sf_dir)}, lambda log: intervals.stream_sessions(log, ["session"], "ts_ms", GAP, DELAY), DELAY_MS)
    got = live.written(spark, folder, "session string, start long, end long, n long").where("session <> ''")
    return got.select("session", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"), "n")


def newest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest visible items of each session."""
    shown = feed.feed(event_log(spark, sf_dir), ORDER, ordered.by_hour("ts"))
    return feed.newest(shown, 3, ORDER, ordered.by_hour("ts")).select("session", "event_id", F.col("place").cast("long").alias("place"), "question", "answer")


#: The least value that so many of so many values don't pass.
QUANTILES = {"median_ms": (1, 2), "p90_ms": (9, 10)}


def _took(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the topic in force at their end, its hour of day, their session and times."""
    log = event_log(spark, sf_dir).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    took = latency.times(log, ORDER, "ms", ordered.by_hour("ts")).withColumnRenamed("session", "user_id")
    known = ordered.as_of(took, topic_changes(spark, sf_dir), ["user_id"], ORDER, "topic", ordered.by_hour("ts"))
    return known.select("topic", F.hour("ts").cast("long").alias("hour"), F.col("user_id").alias("session"), "first_ms", "done_ms")


def answer_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the time from a final transcript to the first piece and to the end of its answer, by topic, hour of day and
    session, and upward."""
    keys = ["topic", "hour", "session"]
    rows = _took(spark, sf_dir).select(*keys, F.explode(F.create_map(F.lit("first"), "first_ms", F.lit("done"), "done_ms")).alias("metric", "ms"))
    levels = latency.merged(latency.cells(rows, ["metric", *keys], "ms"), ["metric"], keys)
    return latency.quantiles(levels, ["metric", *keys, "level"], QUANTILES).withColumnRenamed("most", "most_ms")


def answered_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sessions have answers, by topic and hour of day, and upward: counted, and whether the merged sketches are within
    their error of it."""
    keys, rows = ["topic", "hour"], _took(spark, sf_dir)
    about = latency.distinct(latency.distinct_cells(rows, keys, "session"), keys).withColumnsRenamed({k: f"_{k}" for k in (*keys, "level")})
    levels = [F.struct(*[(F.col(k) if i < n else F.lit(None).cast(rows.schema[k].dataType)).alias(k) for i, k in enumerate(keys)], F.lit(n).alias("level")) for n in range(len(keys) + 1)]
    exact = rows.select(F.explode(F.array(*levels)).alias("_l"), "session").distinct().groupBy("_l").agg(F.count("*").alias("sessions")).select("_l.*", "sessions")
    on = F.col("level") == F.col("_level")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    close = F.abs(F.col("about") - F.col("sessions")) <= latency.DISTINCT_ERROR * F.col("sessions") + 0.5
    return exact.join(about, on).select(*keys, "level", "sessions", close.alias("close"))


QUERIES = {f.__name__: f for f in (packed_blocks, stream_packed_blocks, audio_in_answers, talk_sessions, stream_talk_sessions, newest_items, answer_latency, answered_sessions)}

_GROW = (1 + latency.ERROR) / (1 - latency.ERROR)
_PACKED = sql(
    f""", x as (select vec_id, (vec_id % 2)::varchar as session, samples[1:(vec_id % 65)] as s from blocks),
u as (select session, vec_id, unnest(s) as v, generate_subscripts(s, 1) as i from x),
g as (select session, v, row_number() over (partition by session order by vec_id, i) - 1 as p from u),
w as (select session, p // {blocking.FRAMES} as block, p % {blocking.FRAMES} as f, v, count(*) over (partition by session, p // {blocking.FRAMES}) as n from g),
t as (select session, block, f // 3 as pos, list(v order by f) as l from w where n = {blocking.FRAMES} group by session, block, f // 3),
c as (select session, block, pos, greatest(-1, least(1, (l[1]::double + l[2]::double + l[3]::double) / 3)) as c from t where len(l) = 3)
select session, block, pos, trunc(case when c < 0 then c * 32768 else c * 32767 end)::bigint as sample from c""",
    "blocks",
)
_SESSIONS = sql(
    f""", f as (select session, ts_ms, seq, case when ts_ms - lag(ts_ms) over (partition by session order by ts_ms, seq) < {GAP} then 0 else 1 end as new from full_log),
g as (select *, sum(new) over (partition by session order by ts_ms, seq) as k from f)
select session, min(ts_ms) as start_ms, max(ts_ms) + {GAP} as end_ms, count(*) as n from g group by session, k""",
    "full_log",
)
#: Answers with their times and topics.
_TOOK = f""", s as (select *, epoch_us(ts) // 1000 as ms, coalesce(sum((kind in ('done', 'clear'))::int) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as seg, last_value(case when kind = 'final' then epoch_us(ts) // 1000 end ignore nulls) over (partition by session order by ts, event_id) as asked from event_log),
g as (select session, seg, min(case when kind = 'chunk' then ms end) as first, max(case when kind = 'done' then ms end) as done, max(case when kind = 'done' then ts end) as ts, max(case when kind = 'done' then asked end) as asked from s group by session, seg),
k as (select g.session, g.ts, case when first >= asked then first - asked end as first_ms, done - asked as done_ms, c.topic from (select * from g where done is not null and asked is not null) g asof left join topic_changes c on g.session = c.user_id and g.ts >= c.ts)"""
_LATENCY = sql(
    f"""{_TOOK},
m as (select topic, hour(ts) as hour, session, 'first' as metric, first_ms as ms from k union all select topic, hour(ts), session, 'done', done_ms from k),
b as (select metric, topic, hour, session, 3 - (grouping(topic) + grouping(hour) + grouping(session)) as level, ceil(ln(ms + 1) / {math.log(_GROW)!r}) as bucket, count(*) as n, max(ms) as most from m where ms is not null group by metric, bucket, rollup (topic, hour, session)),
q as (select *, sum(n) over (partition by metric, topic, hour, session, level order by bucket) as upto, sum(n) over (partition by metric, topic, hour, session, level) as total from b)
select metric, topic, hour, session, level::int as level, sum(n)::bigint as n, max(most) as most_ms, """
    + ", ".join(f"floor(2 * pow({_GROW!r}, min(bucket) filter (upto * {b} >= total * {a})) / {_GROW + 1!r} - 0.5)::bigint as {name}" for name, (a, b) in QUANTILES.items())
    + " from q group by metric, topic, hour, session, level",
    "event_log",
    "topic_changes",
)

SQL = {
    "packed_blocks": _PACKED,
    "stream_packed_blocks": _PACKED,
    "audio_in_answers": sql(f"{_TIMELINE}, t as (select *, lag(status) over w as ws, lag(ts) over w as wt from z where status is not null window w as (partition by session order by ts, event_id)), p as (select session, wt as a, ts as b, event_id as ended from t where status = 'capturing' and ws = 'answering') select c.session, c.event_id, p.ended from control_log c join p on c.session = p.session and c.ts >= p.a and c.ts < p.b where c.kind = 'audio' and c.text is not null", "control_log"),
    "talk_sessions": _SESSIONS,
    "stream_talk_sessions": _SESSIONS,
    "newest_items": sql(f", {_ITEMS}, c as (select session, max(ts) as ts from event_log where kind = 'clear' group by session), v as (select i.*, row_number() over (partition by i.session order by i.ts desc, event_id desc) as place from i left join c using (session) where c.ts is null or i.ts > c.ts) select session, event_id, place, question, answer from v where place <= 3", "event_log"),
    "answer_latency": _LATENCY,
    "answered_sessions": sql(f"{_TOOK} select topic, hour(ts) as hour, (2 - (grouping(topic) + grouping(hour(ts))))::int as level, count(distinct session) as sessions, true as close from k group by rollup (topic, hour(ts))", "event_log", "topic_changes"),
}
