"""Golden rows of the text rules, prompts, labels and settings."""

import pytest
from hypothesis import HealthCheck, given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from skeinflow.functions import jstext, labels, prompt, question, settings
from skeinflow.sources import wire

GOLDEN = [
    ("", "empty"), ("\t\n ", "empty"), (None, "empty"), ("?", "qmark"), ("ok?", "qmark"), ("I think so?", "qmark"), ("Is it done ?  ", "qmark"),
    ("I think we should go", "prefix"), ("This island is big", "prefix"), ("what now", "short"), ("can you", "short"), ("What,is,this", "wh"),
    ("what is kubernetes", "wh"), ('"why" not today', "wh"), ("(how) does it work", "wh"), ("what ? is", "wh"), ("what is this", "wh"),
    ("what's the plan here", "none"), ("how-to guide is here", "none"), ("what… is it", "none"), ("so what is that", "none"), ("can you help", "aux"),
    ("Is this working.", "aux"), ("may I ask something", "aux"), ("have they left", "aux"), ("can anyone help me", "none"), ("do the tests pass", "none"),
    ("shall we begin now", "none"), ("done already？", "short"),
]


def test_questions(spark):
    rows = spark.createDataFrame([(i, t, "own") for i, (t, _) in enumerate(GOLDEN)], "id int, text string, words string")
    got = {r["id"]: (r["reason"], r["is_question"]) for r in question.classified(rows).collect()}
    assert got == {i: (c, c in ("qmark", "wh", "aux")) for i, (_, c) in enumerate(GOLDEN)}
    kept = question.gate(rows).orderBy("id").collect()
    assert kept[0].asDict() == {"id": 3, "text": "?", "words": "own"}
    assert {r["id"] for r in kept} == {i for i, (_, c) in enumerate(GOLDEN) if c in ("qmark", "wh", "aux")}


def test_gate_works_texts_out_once(spark, capsys):
    """Though the filter goes below what makes the text, it splits each text once."""
    made = spark.range(10).select("id", F.concat(F.lit("what is "), F.col("id").cast("string")).alias("text"))
    question.gate(made).explain()
    assert capsys.readouterr().out.count("split(") == 1


def test_vocabulary():
    assert (len(question.WH), len(question.AUXILIARIES), len(question.TARGETS), len(question.PREFIXES)) == (9, 16, 10, 9)


@hyp(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="what isCAN you?.,\t 　", max_size=25), min_size=1, max_size=20))
def test_space_and_case_do_not_matter(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, f"\t {t.upper()} \n") for i, t in enumerate(texts)]
    got = question.classified(spark.createDataFrame(rows, "id int, text string")).groupBy("id").agg(F.count_distinct("reason").alias("n"))
    assert all(r["n"] == 1 for r in got.collect())


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column).first()[0]


@pytest.mark.parametrize(("template", "topic", "want"), [("{TOPIC} and {TOPIC}", "x", "x and {TOPIC}"), ("no marker", "x", "no marker"), ("about {TOPIC}.", "$$5", "about $5."), ("about {TOPIC}.", "$&", "about {TOPIC}."), ("about {TOPIC}.", "$1", "about $1."), ("a{TOPIC}b", "$`$'", "aabb"), ("{TOPIC}", "", "")])
def test_first_marker(spark, template, topic, want):
    assert _one(spark, jstext.replace_first(F.col("t"), F.col("v")), t=template, v=topic) == want


def test_prompt(spark):
    lines = _one(spark, prompt.system_prompt(F.col("t"), F.col("v")), t=prompt.DEFAULT_TEMPLATE, v="Kubernetes").split("\n")
    assert lines[0].endswith("Only answer questions about: Kubernetes.") and lines[1:3] == ["", "Policy:"] and len(lines) == 9


@pytest.mark.parametrize(("message", "want"), [
    ('{"type":"Results","channel":{"alternatives":[{"transcript":" hi "}]},"is_final":true}', ("hi", True)),
    ('{"type":"Results","channel":{"alternatives":[{"transcript":" hi "}]},"is_final":false}', ("hi", False)),
    ('{"type":"Results","channel":{"alternatives":[{"transcript":" hi "}]}}', ("hi", False)),
    ('{"type":"Results","channel":{"alternatives":[{"transcript":"a"},{"transcript":"b"}]},"is_final":true}', ("a", True)),
    ('{"type":"Results","channel":{"alternatives":[]}}', None), ('{"type":"Results","channel":{"alternatives":[{"transcript":"   "}]}}', None),
    ('{"type":"Results"}', None), ('{"type":"Metadata"}', None), ("not json", None), (None, None),
])
def test_speech(spark, message, want):
    got = wire.speech(spark.createDataFrame([(message, "old")], "message string, text string")).collect()
    assert [(r["text"], r["is_final"]) for r in got] == ([want] if want else [])


@pytest.mark.parametrize(("message", "want"), [('{"choices":[{"delta":{"content":" Hel"}}]}', " Hel"), ('{"choices":[{"delta":{"content":""}}]}', None), ('{"choices":[{"delta":{"role":"assistant"}}]}', None), ('{"choices":[]}', None), (None, None)])
def test_tokens(spark, message, want):
    got = wire.tokens(spark.createDataFrame([(message,)], "message string")).collect()
    assert [r["text"] for r in got] == ([want] if want else [])


def test_labels(spark):
    rows = spark.createDataFrame([(s, r) for s in labels.STATUSES for r in (True, False)], "s string, r boolean")
    got = {(x["s"], x["r"]): x["l"] for x in rows.select("s", "r", labels.status_label(F.col("r"), F.col("s")).alias("l")).collect()}
    assert {v for (_, r), v in got.items() if not r} == {"Stopped"}
    assert [got[s, True] for s in labels.STATUSES] == ["Starting", "Listening", "Starting", "Answering", "Error"]
    assert _one(spark, labels.transcript_shown(F.col("t")), t="") == "Waiting for speech..."


def test_keys_round_trip(spark):
    assert _one(spark, settings.decrypted(settings.encrypted(F.col("v"), "k" * 16), "k" * 16), v="geheim ü") == "geheim ü"
    assert _one(spark, settings.decrypted(F.col("v"), "k" * 16), v="%%%") == ""
    assert _one(spark, settings.encrypted(F.col("v"), "k" * 16), v="") == ""


def test_settings_document(spark, tmp_path):
    path = str(tmp_path / "settings")
    first = wire.read_settings(spark, environment={"OPENAI_API_KEY": "env"}).first()
    assert first["overlay"].asDict() == settings.OVERLAY and first["apiKeys"].asDict() == {"deepgramApiKey": "", "openAiApiKey": "env"}
    changed = wire.update_keys(wire.update_overlay(wire.update_topic(wire.read_settings(spark, environment={}), "Spark"), x=0), "d", "")
    wire.write_settings(changed, path, "k" * 16)
    assert '"d"' not in "".join(p.read_text() for p in tmp_path.glob("settings/part-*"))
    again = wire.read_settings(spark, path, "k" * 16, {"OPENAI_API_KEY": "env"}).first()
    assert again["topic"] == "Spark" and again["overlay"]["x"] == 0 and again["overlay"]["width"] == 540
    assert again["apiKeys"].asDict() == {"deepgramApiKey": "d", "openAiApiKey": "env"}


def test_audio_track(spark):
    tracks = spark.createDataFrame([("a", "video"), ("a", "audio"), ("b", "video")], "source string, track string")
    assert [r["track"] for r in wire.with_audio_track(tracks.where("source = 'a'")).collect()] == ["audio"]
    with pytest.raises(Exception, match="No audio track"):
        wire.with_audio_track(tracks).collect()
