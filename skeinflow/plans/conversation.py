"""Queries over utterances, messages, event logs and requests, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jstext, labels, prompt, question
from ..operators import answers, feed, ordered, status
from ..sources import wire
from .inputs import ORDER, answer_messages, control_log, event_log, speech_messages, sql, table, topic_changes, utterances


def _hour():
    return ordered.by_hour("ts")


def question_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each utterance, with the first two."""
    rows = question.classified(utterances(spark, sf_dir))
    return rows.select("event_id", F.array_join("words", "|").alias("words"), F.size("words").cast("long").alias("n_words"), question.word(F.col("words"), 0).alias("first_word"), question.word(F.col("words"), 1).alias("second_word"))


def question_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each utterance is a question, and the rule that decides."""
    return question.classified(utterances(spark, sf_dir)).select("event_id", "is_question", "reason")


def question_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final utterances that are questions; every seventh is interim."""
    rows = utterances(spark, sf_dir).withColumn("is_final", F.col("event_id") % 7 != 0)
    return question.gate(rows, final="is_final").select("event_id", "user_id", "text")


def conversation_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations that are questions, by rule."""
    rows = question.classified(table(spark, sf_dir, "conversations").where("role = 'user'"))
    return rows.groupBy("reason").agg(F.count("*").alias("turns"))


def stt_extract_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final and interim transcripts of speech messages."""
    final, interim = wire.route(wire.speech(speech_messages(spark, sf_dir)))
    tag = lambda df, name: df.select("event_id", "text", F.lit(name).alias("route"))
    return tag(final, "final").unionByName(tag(interim, "interim"))


def token_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of answers in messages of the answer service."""
    return wire.tokens(answer_messages(spark, sf_dir)).select("event_id", "text")


def live_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.live_transcript(event_log(spark, sf_dir), ORDER)


def current_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question in force at each chunk and end."""
    rows = feed.segments(event_log(spark, sf_dir), ORDER, _hour())
    return rows.where("kind in ('chunk', 'done')").select("session", "event_id", F.coalesce("question", F.lit("")).alias("question"))


def open_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.open_draft(event_log(spark, sf_dir), ORDER, _hour())


def qa_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items, whether a later clear hides them or not."""
    return feed.items(event_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id", "question", "answer")


def qa_feed_after_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items that are visible at the end."""
    return feed.feed(event_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id", "question", "answer")


def feed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each visible item in the view, newest first."""
    shown = feed.feed(event_log(spark, sf_dir), ORDER, _hour())
    return feed.placed(shown, ORDER, _hour()).select("session", "event_id", "place")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = question.gate(utterances(spark, sf_dir))
    got = ordered.as_of(asked, topic_changes(spark, sf_dir), ["user_id"], ORDER, "topic", _hour())
    return got.withColumn("topic", F.coalesce("topic", F.lit(prompt.DEFAULT_TOPIC)))


def topic_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with the topic in force when it is asked."""
    return _asked(spark, sf_dir).select("event_id", "user_id", "text", "topic")


#: Templates by event_id modulo 3: the default one, one with two markers, one with none.
TEMPLATES = [prompt.DEFAULT_TEMPLATE, "{TOPIC} and {TOPIC}", "no marker"]


def _template():
    at = F.col("event_id") % 3
    return F.when(at == 0, TEMPLATES[0]).when(at == 1, TEMPLATES[1]).otherwise(TEMPLATES[2])


def system_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("event_id", prompt.system_prompt(_template(), F.col("topic")).alias("prompt"))


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _asked(spark, sf_dir).select("event_id", F.posexplode(prompt.messages(_template(), F.col("topic"), F.col("text"))).alias("pos", "m"))
    return rows.select("event_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


#: Templates, and topics with dollar signs, by event_id; {} is the event's type.
PATTERN_TEMPLATES = ["about {TOPIC}.", "a {TOPIC} b {TOPIC}", "no marker", "{TOPIC}"]
PATTERN_TOPICS = ["$$5 {}", "$& {}", "$1 {}", "$$& {}", "[$`|$'] {}", "{}", ""]


def topic_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with dollar signs in templates."""
    at = F.col("event_id")
    chosen = lambda forms: F.replace(F.element_at(F.array(*map(F.lit, forms)), (at % len(forms) + 1).cast("int")), F.lit("{}"), F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", chosen(PATTERN_TEMPLATES).alias("template"), chosen(PATTERN_TOPICS).alias("topic"))
    return rows.select("event_id", jstext.replace_first(F.col("template"), F.col("topic")).alias("text"))


def answer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the stand-in provider's answers to all questions."""
    requests = _asked(spark, sf_dir).select("event_id", "topic", F.lit(prompt.DEFAULT_TEMPLATE).alias("template"), F.col("text").alias("question"))
    return answers.stream(requests).select("event_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), "chunk")


def answered_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From utterances to the feed: gate, topic, request, answer, event log, fold."""
    said = utterances(spark, sf_dir).withColumnRenamed("user_id", "session").withColumn("text", jstext.trim(F.col("text"))).where("text <> ''")
    asked = question.gate(said)
    requests = asked.select("session", *ORDER, F.lit(prompt.DEFAULT_TOPIC).alias("topic"), F.lit(prompt.DEFAULT_TEMPLATE).alias("template"), F.col("text").alias("question"))
    log = answers.conversation(said, requests, ORDER)
    return feed.feed(log, [*ORDER, "step"], _hour()).select("session", "event_id", "question", "answer")


def status_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.timeline(control_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id", "status")


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each session ends."""
    return status.last_status(control_log(spark, sf_dir), ORDER, _hour())


def first_chunk_diagnostic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.diagnostics(control_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id", "text")


def audio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audio chunks that reach the speech service."""
    return status.audio_kept(control_log(spark, sf_dir), ORDER, _hour()).select("session", "event_id")


def audio_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.audio_counts(control_log(spark, sf_dir), ORDER, _hour())


def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses with and without capture, by the events: labels of the status line and the button."""
    status_ = F.element_at(F.array(*map(F.lit, labels.STATUSES)), (F.col("event_id") % len(labels.STATUSES) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", status_.alias("status"), F.when(F.col("event_type") != "view", F.col("event_type") != "error").alias("running"))
    return rows.select("event_id", "status", "running", labels.status_label(F.col("running"), F.col("status")).alias("label"), labels.button_label(F.col("running")).alias("button"))


#: Names of errors by event_id.
ERROR_NAMES = ["NotSupportedError", "NotAllowedError", "AbortError", "TypeError"]


def error_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What failed starts, stops, loads, saves and the speech service say of errors, made of the events; every fifth is no error
    and has no message."""
    n = F.col("event_id")
    kind = F.when(n % 5 == 0, "other").when(n % 2 == 0, "dom").otherwise("error")
    rows = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), F.element_at(F.array(*map(F.lit, ERROR_NAMES)), (n % 4 + 1).cast("int")).alias("name"), F.when(n % 5 != 0, F.concat(F.col("event_type"), F.lit(" "), n.cast("string"))).alias("message"))
    return rows.select("event_id", labels.start_error(F.col("kind"), F.col("name"), F.col("message")).alias("start"), *[labels.failure(a, F.col("message")).alias(a) for a in ("stop", "load", "save", "stt")])


def transcript_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the live row shows for each session."""
    return live_transcript(spark, sf_dir).select("session", labels.transcript_shown(F.col("transcript")).alias("shown"))


QUERIES = {f.__name__: f for f in (question_tokens, question_reason, question_gate, conversation_questions, stt_extract_route, token_extract, live_transcript, current_question, open_draft, qa_feed, qa_feed_after_clear, feed_places, topic_asof, system_prompt, chat_messages, topic_patterns, answer_stream, answered_feed, status_timeline, session_status, first_chunk_diagnostic, audio_gate, audio_counter, status_label, error_format, transcript_shown)}

_S = jstext.SPACE
_list = lambda words: ", ".join(f"'{w}'" for w in words)


def _classified(rows: str) -> str:
    """Adds t, w and reason to a relation with a text."""
    opens = " or ".join(f"starts_with(t, '{p}')" for p in question.PREFIXES)
    return rf"""n0 as (select *, lower(regexp_replace(coalesce(text, ''), '\A{_S}+|{_S}+\z', '', 'g')) as t from {rows}),
n1 as (select *, list_filter(string_split_regex(regexp_replace(t, '{question.PUNCTUATION}', ' ', 'g'), '{_S}+'), lambda x: x <> '') as w from n0),
n2 as (select *, case when t = '' then 'empty' when ends_with(t, '?') then 'qmark' when {opens} then 'prefix' when len(w) < 3 then 'short'
  when w[1] in ({_list(question.WH)}) then 'wh' when w[1] in ({_list(question.AUXILIARIES)}) and w[2] in ({_list(question.TARGETS)}) then 'aux' else 'none' end as reason from n1)"""


_ASKS = "reason in ('qmark', 'wh', 'aux')"
_SEGMENTS = """s as (select *, coalesce(sum((kind in ('done', 'clear'))::int) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as seg,
  last_value(case when kind = 'final' then text end ignore nulls) over (partition by session order by ts, event_id rows between unbounded preceding and current row) as q from event_log)"""
_ITEMS = _SEGMENTS + """, g as (select session, seg, string_agg(case when kind = 'chunk' then text end, '' order by ts, event_id) as draft, max(case when kind = 'done' then event_id end) as event_id,
  max(case when kind = 'done' then ts end) as ts, max(case when kind = 'done' then q end) as question from s group by all),
i as (select session, event_id, ts, question, trim(draft) as answer from g where event_id is not null and question <> '' and trim(draft) <> '')"""
_ASKED = _classified("utterances") + f", a as (select n2.event_id, n2.user_id, n2.text, coalesce(c.topic, '{prompt.DEFAULT_TOPIC}') as topic from n2 asof left join topic_changes c on n2.user_id = c.user_id and n2.ts >= c.ts where {_ASKS})"
_PROMPT = "(case event_id % 3 when 0 then replace('{}', '{{TOPIC}}', topic) when 1 then topic || ' and {{TOPIC}}' else 'no marker' end || '\n' || '{}')".format(prompt.DEFAULT_TEMPLATE, "\n".join(prompt.POLICY))
_ACTIVE = """, v as (select *, coalesce(last_value(case when kind in ('start', 'stop') then kind end ignore nulls) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding), 'stop') = 'start' as active,
  coalesce(sum((kind = 'start')::int) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as starts,
  coalesce(sum((kind = 'stop')::int) over (partition by session order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as stops from control_log)"""
_TIMELINE = _ACTIVE + ", " + _classified("v") + f""", z as (select session, ts, event_id, case when kind = 'start' and not active then 'capturing' when kind = 'stop' and active then 'idle'
  when kind = 'final' and active and {_ASKS} then 'answering' when kind = 'error' and active then 'error' when kind = 'done' then 'capturing' end as status from n2)"""
_LABEL = "case when not running then 'Stopped' when status = 'capturing' then 'Listening' when status = 'answering' then 'Answering' when status = 'error' then 'Error' else 'Starting' end"
_LIVE = "select session, coalesce(arg_max(case when kind = 'final' then text else '' end, (ts, event_id)), '') as transcript from event_log where kind in ('final', 'clear') group by session"

#: What a topic puts in, by event_id, given what stands before and after the marker.
_PATTERNS = f"""with e as (select event_id, event_type as t, {PATTERN_TEMPLATES}[event_id % {len(PATTERN_TEMPLATES)} + 1] as template from events),
p as (select *, strpos(template, '{{TOPIC}}') as pos from e),
x as (select *, left(template, pos - 1) as before, substr(template, pos + 7) as after from p where pos > 0),
y as (select *, case event_id % 7 when 0 then '$5 ' || t when 1 then '{{TOPIC}} ' || t when 2 then '$1 ' || t when 3 then '$& ' || t when 4 then '[' || before || '|' || after || '] ' || t when 5 then t else '' end as put from x)
select event_id, before || put || after as text from y union all select event_id, template from p where pos = 0"""

SQL = {
    "question_tokens": sql(f", {_classified('utterances')} select event_id, array_to_string(w, '|') as words, len(w)::bigint as n_words, coalesce(w[1], '') as first_word, coalesce(w[2], '') as second_word from n2", "utterances"),
    "question_reason": sql(f", {_classified('utterances')} select event_id, {_ASKS} as is_question, reason from n2", "utterances"),
    "question_gate": sql(f", {_classified('utterances')} select event_id, user_id, text from n2 where {_ASKS} and event_id % 7 <> 0", "utterances"),
    "conversation_questions": f"with {_classified('conversations')} select reason, count(*) as turns from n2 where role = 'user' group by reason",
    "stt_extract_route": sql(", m as (select event_id, trim(coalesce(json_extract_string(message, '$.channel.alternatives[0].transcript'), '')) as text, message from speech_messages where json_extract_string(message, '$.type') = 'Results') select event_id, text, case when json_extract_string(message, '$.is_final') = 'true' then 'final' else 'interim' end as route from m where text <> ''", "speech_messages"),
    "token_extract": sql("select event_id, json_extract_string(message, '$.choices[0].delta.content') as text from answer_messages where json_extract_string(message, '$.choices[0].delta.content') <> ''", "answer_messages"),
    "live_transcript": sql(_LIVE, "event_log"),
    "current_question": sql(f", {_SEGMENTS} select session, event_id, coalesce(q, '') as question from s where kind in ('chunk', 'done')", "event_log"),
    "open_draft": sql(", e as (select session, max((ts, event_id)) as at from event_log where kind in ('done', 'clear') group by session) select event_log.session, string_agg(text, '' order by ts, event_id) as draft from event_log left join e using (session) where kind = 'chunk' and (e.at is null or (ts, event_id) > e.at) group by event_log.session", "event_log"),
    "qa_feed": sql(f", {_ITEMS} select session, event_id, question, answer from i", "event_log"),
    "qa_feed_after_clear": sql(f", {_ITEMS}, c as (select session, max(ts) as ts from event_log where kind = 'clear' group by session) select i.session, event_id, question, answer from i left join c using (session) where c.ts is null or i.ts > c.ts", "event_log"),
    "feed_places": sql(f", {_ITEMS}, c as (select session, max(ts) as ts from event_log where kind = 'clear' group by session), v as (select i.* from i left join c using (session) where c.ts is null or i.ts > c.ts) select session, event_id, row_number() over (partition by session order by ts desc, event_id desc) as place from v", "event_log"),
    "topic_asof": sql(f", {_ASKED} select event_id, user_id, text, topic from a", "utterances", "topic_changes"),
    "system_prompt": sql(f", {_ASKED} select event_id, {_PROMPT} as prompt from a", "utterances", "topic_changes"),
    "chat_messages": sql(f", {_ASKED} select event_id, 0::bigint as pos, 'system' as role, {_PROMPT} as content from a union all select event_id, 1, 'user', text from a", "utterances", "topic_changes"),
    "topic_patterns": _PATTERNS,
    "answer_stream": sql(f", {_classified('utterances')}, p as (select event_id, list_prepend('You asked:', list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: ' ' || x)) as l from n2 where {_ASKS}) select event_id, i - 1 as chunk_idx, l[i] as chunk from (select event_id, l, unnest(range(1, len(l) + 1)) as i from p)", "utterances"),
    "answered_feed": sql(f", {_classified('utterances')} select user_id as session, event_id, trim(text) as question, 'You asked: ' || array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') as answer from n2 where {_ASKS}", "utterances"),
    "status_timeline": sql(f"{_TIMELINE} select session, event_id, status from z where status is not null", "control_log"),
    "session_status": sql(f"{_TIMELINE}, l as (select session, arg_max(status, (ts, event_id)) filter (status is not null) as s from z group by session), k as (select session, coalesce(arg_max(kind, (ts, event_id)) filter (kind in ('start', 'stop')), 'stop') = 'start' as running from control_log group by session), b as (select session, coalesce(s, 'idle') as status, running from k left join l using (session)) select session, status, running, {_LABEL} as label from b", "control_log"),
    "first_chunk_diagnostic": sql(f"{_ACTIVE} select session, arg_min(event_id, (ts, event_id)) as event_id, '{labels.FIRST_SOUND}' as text from v where kind = 'audio' and text is not null and starts > 0 group by session, starts union all select session, arg_min(event_id, (ts, event_id)), '{labels.FIRST_SENT}' from v where kind = 'audio' and text is not null and active group by session, stops union all select session, event_id, '{labels.CONNECTED}' from v where kind = 'start' and not active", "control_log"),
    "audio_gate": sql(f"{_ACTIVE} select session, event_id from v where kind = 'audio' and active and text is not null", "control_log"),
    "audio_counter": sql(f"{_ACTIVE} select session, starts::bigint as starts, count(*) as chunks from v where kind = 'audio' and text is not null and starts > 0 group by session, starts", "control_log"),
    "status_label": f"with e as (select event_id, {labels.STATUSES}[event_id % 5 + 1] as status, case event_type when 'view' then null when 'error' then false else true end as running from events) select event_id, status, running, case when running is null then 'Stopped' else {_LABEL} end as label, case when running then 'Stop' else 'Start' end as button from e",
    "error_format": f"with e as (select event_id, case when event_id % 5 = 0 then 'other' when event_id % 2 = 0 then 'dom' else 'error' end as kind, {ERROR_NAMES}[event_id % 4 + 1] as name, case when event_id % 5 <> 0 then event_type || ' ' || event_id end as message from events) select event_id, case kind when 'dom' then case name when 'NotSupportedError' then '{labels.NOT_SUPPORTED}' when 'NotAllowedError' then '{labels.NOT_ALLOWED}' else name || ': ' || message end when 'error' then message else '{labels.UNKNOWN_START}' end as start, "
    + ", ".join(f"'{p}' || coalesce(message, '{d}') as {a}" for a, (p, d) in labels.FALLBACKS.items() if a != "start")
    + " from e",
    "transcript_shown": sql(f"select session, case when transcript = '' then 'Waiting for speech...' else transcript end as shown from ({_LIVE})", "event_log"),
}
