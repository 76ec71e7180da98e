"""Inputs of the queries, derived from the tables, and the same in SQL.

The tables hold hardly any questions, messages of services or audio, so these are made of `events` and
`embeddings` by fixed rules. Each Spark frame has its SQL under the same name in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio

#: By event_id modulo 12; {} is the event's type.
UTTERANCES = ["What is {} doing", "what {}", "Can you explain {}.", "can anyone explain {}", "I think {} is fine", "I think {} is fine?", "  Is this {} ok ?  ", "what's the {} plan", '(how) does "{}" work', "   ", "ok {}", "how-to guide for {}"]
#: By event_id modulo 9, messages of the speech service; {} is the event's type.
SPEECH = [
    '{"type":"Results","channel":{"alternatives":[{"transcript":" {} "}]},"is_final":true}',
    '{"type":"Results","channel":{"alternatives":[{"transcript":" {} "}]},"is_final":false}',
    '{"type":"Results","channel":{"alternatives":[{"transcript":"{} so far"}]}}',
    '{"type":"Results","channel":{"alternatives":[{"transcript":"a {}"},{"transcript":"b"}]},"is_final":true}',
    '{"type":"Results","channel":{"alternatives":[]},"is_final":true}',
    '{"type":"Results","channel":{"alternatives":[{"transcript":"   "}]},"is_final":true}',
    '{"type":"Results","is_final":true}',
    '{"type":"Metadata"}',
    '{"type":"Results","channel":{"alternatives":[{"confidence":1}]},"is_final":true}',
]
#: By event_id modulo 5, messages of the answer service.
ANSWER = ['{"choices":[{"delta":{"content":" {}"}}]}', '{"choices":[{"delta":{"content":""}}]}', '{"choices":[{"delta":{"role":"assistant"}}]}', '{"choices":[]}', '{"choices":[{"delta":{"content":"{} "}},{"delta":{"content":"no"}}]}']
GAIN = 16.0
#: What an error event is in the full log, by event_id.
OFF = ["clear", "stop", "error", "keys", "failed"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chosen(forms: list[str]):
    at = F.col("event_id") % len(forms)
    text = F.when(at == 0, F.lit(forms[0]))
    for i, form in enumerate(forms[1:], 1):
        text = text.when(at == i, F.lit(form))
    return F.replace(text, F.lit("{}"), F.col("event_type"))


def _sql(forms: list[str]) -> str:
    cases = " ".join("when {} then '{}'".format(i, f.replace("'", "''")) for i, f in enumerate(forms))
    return f"replace(case event_id % {len(forms)} {cases} end, '{{}}', event_type)"


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", _chosen(UTTERANCES).alias("text"))


def speech_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _chosen(SPEECH).alias("message"))


def answer_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", _chosen(ANSWER).alias("message"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final transcripts, chunks of answers, ends and clears by session, ordered by ts and event_id."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    made = F.when(kind == "signup", F.struct(F.lit("final").alias("kind"), F.concat(F.lit("what is "), n).alias("text")))
    made = made.when(kind == "click", F.struct(F.lit("chunk").alias("kind"), F.concat(F.lit(" c"), n).alias("text")))
    made = made.when(kind == "view", F.struct(F.lit("chunk").alias("kind"), F.concat(F.lit("v"), n, F.lit(" ")).alias("text")))
    made = made.when(kind == "purchase", F.struct(F.lit("done").alias("kind"), F.lit(None).cast("string").alias("text")))
    made = made.when(kind == "error", F.struct(F.lit("clear").alias("kind"), F.lit(None).cast("string").alias("text")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", made.alias("m")).select("session", "ts", "event_id", "m.*")


def control_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts, stops, utterances, ends of answers, errors and audio chunks (every third empty) by session."""
    kind = F.col("event_type")
    made = F.when(kind == "signup", "start").when(kind == "error", "stop").when(kind == "click", "final").when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "done").otherwise("error")).when(kind == "view", "audio")
    text = F.when(kind == "click", _chosen(UTTERANCES)).when((kind == "view") & (F.col("event_id") % 3 != 0), F.lit("sound"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), "ts", "event_id", made.alias("kind"), text.alias("text"))


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The control log with failed starts, saved keys and interim transcripts."""
    kind, n = F.col("kind"), F.col("event_id")
    made = F.when((kind == "stop") & (n % 3 == 0), "failed").when((kind == "final") & (n % 11 == 0), "keys").when((kind == "audio") & (n % 7 == 0), "interim").otherwise(kind)
    text = F.when((kind == "audio") & (n % 7 == 0), F.concat(F.lit("so far "), n.cast("string"))).when(~((kind == "final") & (n % 11 == 0)), F.col("text"))
    return control_log(spark, sf_dir).select("session", "ts", "event_id", made.alias("kind"), text.alias("text"))


def full_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of all kinds in the schema of the event log, in the order of event_id."""
    kind, n = F.col("event_type"), F.col("event_id")
    off = F.element_at(F.array(*map(F.lit, OFF)), (n % len(OFF) + 1).cast("int"))
    made = F.when(kind == "signup", F.when(n % 2 == 0, "start").otherwise("final")).when(kind == "click", "chunk").when(kind == "view", F.when(n % 5 == 0, "audio").when(n % 5 == 1, "interim").otherwise("chunk")).when(kind == "purchase", "done").when(kind == "error", off)
    text = F.when(~made.isin("start", "done", *OFF) | (made == "error"), F.concat(F.when(made == "final", "what is ").otherwise(" "), n.cast("string")))
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session"), n.alias("seq"), made.alias("kind"), text.alias("text"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


def topic_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's name as the session's topic from each purchase on."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id", (F.col("event_id") % 25).cast("int").alias("n"))
    return bought.join(table(spark, sf_dir, "nation"), F.col("n") == F.col("n_nationkey")).select("user_id", "ts", "event_id", F.col("n_name").alias("topic"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as audio blocks, loud enough that many samples are clamped."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * F.lit(GAIN).cast("float")).cast("float")).alias("samples"))


SQL = {
    "utterances": f"select event_id, user_id, ts, {_sql(UTTERANCES)} as text from events",
    "speech_messages": f"select event_id, {_sql(SPEECH)} as message from events",
    "answer_messages": f"select event_id, {_sql(ANSWER)} as message from events",
    "event_log": "select user_id as session, ts, event_id, case event_type when 'signup' then 'final' when 'click' then 'chunk' when 'view' then 'chunk' when 'purchase' then 'done' when 'error' then 'clear' end as kind, case event_type when 'signup' then 'what is ' || event_id when 'click' then ' c' || event_id when 'view' then 'v' || event_id || ' ' end as text from events",
    "control_log": f"select user_id as session, ts, event_id, case event_type when 'signup' then 'start' when 'error' then 'stop' when 'click' then 'final' when 'purchase' then (case when event_id % 2 = 0 then 'done' else 'error' end) when 'view' then 'audio' end as kind, case when event_type = 'click' then {_sql(UTTERANCES)} when event_type = 'view' and event_id % 3 <> 0 then 'sound' end as text from events",
    "call_log": "select session, ts, event_id, case when kind = 'stop' and event_id % 3 = 0 then 'failed' when kind = 'final' and event_id % 11 = 0 then 'keys' when kind = 'audio' and event_id % 7 = 0 then 'interim' else kind end as kind, case when kind = 'audio' and event_id % 7 = 0 then 'so far ' || event_id when not (kind = 'final' and event_id % 11 = 0) then text end as text from control_log",
    "full_log": f"select *, case when kind not in ('start', 'done', 'clear', 'stop', 'keys', 'failed') then (case kind when 'final' then 'what is ' else ' ' end) || seq end as text from (select user_id::varchar as session, event_id as seq, case event_type when 'signup' then (case when event_id % 2 = 0 then 'start' else 'final' end) when 'click' then 'chunk' when 'view' then (case event_id % 5 when 0 then 'audio' when 1 then 'interim' else 'chunk' end) when 'purchase' then 'done' when 'error' then {OFF}[event_id % 5 + 1] end as kind, epoch_us(ts) // 1000 as ts_ms from events)",
    "topic_changes": "select user_id, ts, event_id, n_name as topic from events join nation on n_nationkey = event_id % 25 where event_type = 'purchase'",
    "blocks": f"select vec_id, list_transform(embedding, lambda x: (x * {GAIN}::float)::float) as samples from embeddings",
}


def sql(body: str, *names: str) -> str:
    """A query over the derived inputs of these names."""
    return f"with {', '.join(f'{n} as ({SQL[n]})' for n in names)}{'' if body.startswith(',') else ' '}{body}"


ORDER = ["ts", "event_id"]
RATE, OUT = audio.INPUT_RATE, audio.OUTPUT_RATE
