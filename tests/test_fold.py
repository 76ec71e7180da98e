"""Golden traces of the fold, whatever the blocks, and the stream against the batch."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import answers, feed, ordered, status
from skeinflow.sources import wire
from skeinflow.streaming import fold

#: kind:text, in order; the feed, newest first; the live transcript.
TRACES = {
    "basic": (["final:what is x", "chunk: A", "chunk:B ", "done"], [("what is x", "AB")], "what is x"),
    "as of": (["final:what is x", "chunk:A", "final:ok thanks", "chunk:B", "done"], [("ok thanks", "AB")], "ok thanks"),
    "mixed": (["final:what is x", "chunk:a1", "final:why is y", "chunk:b1", "chunk:a2", "done", "chunk:b2", "done"], [("why is y", "b2"), ("why is y", "a1b1a2")], "why is y"),
    "clear": (["final:what is x", "chunk:A", "done", "final:why is y", "chunk:B1", "clear", "done", "chunk:B2", "done"], [("why is y", "B2")], ""),
    "residue": (["final:what is x", "chunk:par", "final:why is y", "chunk:B", "done"], [("why is y", "parB")], "why is y"),
    "blank": (["final:what is x", "chunk:  ", "done"], [], "what is x"),
    "early": (["chunk:A", "done", "final:what is x", "chunk:B", "done"], [("what is x", "B")], "what is x"),
    "interim": (["final:what is x", "interim:so uh", "chunk:A", "done"], [("what is x", "A")], "so uh"),
    "twice": (["final:what is x", "chunk:A", "done", "done"], [("what is x", "A")], "what is x"),
    "open": (["final:what is x", "chunk:A", "chunk: B"], [], "what is x"),
}


def _log(spark):
    rows = [(s, i, *(e.split(":", 1) + [None])[:2], 1000 + i) for s, (events, _, _) in TRACES.items() for i, e in enumerate(events)]
    rows += [(None, 1, "done", None, 1), ("basic", None, "clear", None, 1)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, wire.EVENT_LOG)


@pytest.mark.parametrize("size", [1, 2, 65536])
def test_traces(spark, size):
    log, block = _log(spark), ordered.by_number("seq", size)
    found = {}
    for r in feed.newest_first(feed.feed(log, block=block)).collect():
        found.setdefault(r["session"], []).append((r["question"], r["answer"]))
    assert found == {s: want for s, (_, want, _) in TRACES.items() if want}
    assert {r["session"]: r["draft"] for r in feed.open_draft(log, block=block).collect()} == {"open": "A B"}


def test_views(spark):
    log = _log(spark)
    assert {r["session"]: r["transcript"] for r in feed.live_transcript(log).collect()} == {s: live for s, (_, _, live) in TRACES.items()}
    assert {r["session"]: r["question"] for r in feed.current_question(log).collect()}["clear"] == "why is y"


def test_empty_log(spark):
    log = _log(spark).limit(0)
    assert feed.feed(log).count() == feed.open_draft(log).count() == feed.live_transcript(log).count() == status.timeline(log).count() == 0


def test_running_against_plain(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, "x", "y"])) for i in range(200)]
    got = ordered.running(spark.createDataFrame(rows, "k string, seq int, v string"), ["k"], ["seq"], ordered.by_number("seq", 7), counts={"n": F.col("v") == "x"}, lasts={"last": F.col("v")}, before={"prior": F.col("v")})
    seen = {k: [] for k in "ab"}
    want = {}
    for k, seq, v in rows:
        known = [x for x in seen[k] if x]
        want[seq] = (seen[k].count("x"), v or (known[-1] if known else None), known[-1] if known else None)
        seen[k].append(v)
    assert {r["seq"]: (r["n"], r["last"], r["prior"]) for r in got.collect()} == want
    assert {(r["k"], r["n_total"]) for r in got.collect()} == {(k, vs.count("x")) for k, vs in seen.items()}


def test_as_of_ties(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 5, 11), ("b", 5, 12)], "k string, seq int, id int")
    changes = spark.createDataFrame([("a", 5, "t5"), ("a", 0, "t0"), (None, 0, "no")], "k string, seq int, topic string")
    got = ordered.as_of(rows, changes, ["k"], ["seq"], "topic", ordered.by_number("seq", 2))
    assert {r["id"]: r["topic"] for r in got.collect()} == {10: "t0", 11: "t5", 12: None}


#: A call whose keys are saved: its connection stays open, a stop says nothing, and later calls still hear it.
CALLS = ["final:what is early", "start", "keys", "audio:s", "final:what is it now", "stop", "error:", "start", "failed", "final:why is it", "interim:so", "done", "audio:s", "error:lost"]
#: A start that fails; results after it are late.
FAILED = ["start", "interim:hm", "failed", "final:what is late", "interim:late", "error:late", "chunk:A", "done", "failed"]
CONTROL = ["start", "start", "audio:", "audio:s", "final:what is it now", "stop", "stop", "final:what is it now", "error:late", "done", "start", "error:x", "audio:s"]


def _control(spark):
    rows = [(s, i, e.split(":")[0], (e.split(":") + [None])[1] or None, 0) for s, events in (("s", CONTROL), ("calls", CALLS), ("failed", FAILED)) for i, e in enumerate(events)]
    return spark.createDataFrame(rows, wire.EVENT_LOG)


@pytest.mark.parametrize("size", [1, 3, 65536])
def test_calls(spark, size):
    log, block = _control(spark), ordered.by_number("seq", size)
    got = {}
    for r in status.timeline(log, block=block).orderBy("seq").collect():
        got.setdefault(r["session"], []).append((r["seq"], r["status"]))
    assert got["calls"] == [(1, "capturing"), (4, "answering"), (6, "error"), (7, "capturing"), (8, "idle"), (9, "answering"), (11, "capturing"), (13, "error")]
    assert got["failed"] == [(0, "capturing"), (2, "idle"), (7, "capturing")]
    last = {r["session"]: (r["status"], r["running"], r["label"]) for r in status.last_status(log, block=block).collect()}
    assert last["calls"] == ("error", False, "Stopped") and last["failed"] == ("error", False, "Stopped")
    heard = {(r["session"], r["seq"]) for r in status.heard(log, block=block).where("kind in ('interim', 'final', 'error')").collect()}
    assert heard == {("s", 4), ("s", 11), ("failed", 1)} | {("calls", i) for i in (0, 4, 6, 9, 10, 13)}
    assert [r["seq"] for r in status.audio_kept(log, block=block).where("session = 'calls'").collect()] == []
    assert {(r["session"], r["starts"], r["chunks"]) for r in status.audio_counts(log, block=block).collect()} == {("s", 2, 1), ("s", 3, 1), ("calls", 2, 1)}
    assert {r["session"]: r["transcript"] for r in feed.live_transcript(status.heard(log, block=block)).collect()} == {"s": "STT error: x", "calls": "STT error: lost", "failed": "hm"}
    assert feed.feed(status.heard(log, block=block)).count() == 0 and feed.feed(log).where("session = 'failed'").count() == 1


def test_status(spark):
    log = _control(spark).where("session = 's'")
    got = [(r["seq"], r["status"]) for r in status.timeline(log, block=ordered.by_number("seq", 3)).orderBy("seq").collect()]
    assert got == [(0, "capturing"), (4, "answering"), (5, "idle"), (9, "capturing"), (10, "capturing"), (11, "error")]
    last = status.last_status(log).first()
    assert (last["status"], last["running"], last["label"]) == ("error", True, "Error")
    assert [r["seq"] for r in status.audio_kept(log).orderBy("seq").collect()] == [3, 12]
    told = sorted((r["seq"], r["text"]) for r in status.diagnostics(log).collect())
    assert [s for s, _ in told] == [0, 3, 3, 10, 12, 12]


def test_answers(spark):
    rows = spark.createDataFrame([(1, "t", None, "a b"), (2, None, "p", None)], "id int, topic string, template string, question string")
    got = [(r["id"], r["chunk_idx"], r["chunk"]) for r in answers.stream(rows).orderBy("id", "chunk_idx").collect()]
    assert got == [(1, 0, "You asked:"), (1, 1, " a"), (1, 2, " b"), (2, 0, "You asked:")]
    own = answers.stream(rows, lambda r: iter(["", r.topic, "!"])).where("id = 1").orderBy("chunk_idx").collect()
    assert [r["chunk"] for r in own] == ["t", "!"]


def test_answer_that_fails(spark):
    """It has no end: what it gave stays in the draft and comes before the next answer."""

    def provider(request):
        yield "part " if request.question == "what is x" else "whole"
        if request.question == "what is x":
            raise ConnectionError("lost")

    finals = spark.createDataFrame([("s", 1, "what is x"), ("s", 2, "why is y")], "session string, seq int, text string")
    requests = finals.select("session", "seq", F.lit("").alias("topic"), F.lit("").alias("template"), F.col("text").alias("question"))
    log = answers.conversation(finals, requests, ["seq"], provider)
    got = [(r["question"], r["answer"]) for r in feed.feed(log, ["seq", "step"], ordered.by_number("seq")).collect()]
    assert got == [("why is y", "part whole")]
    assert [r["failure"] for r in answers.told(requests, provider).where("chunk is null").orderBy("seq").collect()] == ["lost", None]


def test_source_without_audio(spark):
    tracks = spark.createDataFrame([("a", "audio"), ("a", "video"), ("b", "audio")], "source string, track string")
    assert sorted(r["source"] for r in wire.with_audio_track(tracks).collect()) == ["a", "b"]
    with pytest.raises(Exception, match="No audio track"):
        wire.with_audio_track(tracks.unionByName(spark.createDataFrame([("c", "video")], tracks.schema))).collect()


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"session": "a", "seq": i, "kind": k, "text": t, "ts_ms": 10 * i}) for i, (k, t) in enumerate([("start", None), ("final", "what is it now"), ("chunk", "A"), ("done", None)])))
    got = {}
    sink = lambda name: lambda df: got.setdefault(name, []).extend(sorted((r["seq"], r["kind"], r["text"], r["ts_ms"]) for r in df.collect()))
    rows = fold.fold(wire.events(spark, str(tmp_path / "in"), streaming=True))
    fold.to_windows(rows, sink("overlay"), [sink("settings")], str(tmp_path / "cp")).awaitTermination(120)
    assert got["settings"] == [(0, "interim", "STT connected. Waiting for speech...", 0), (1, "final", "what is it now", 10), (2, "chunk", "A", 20), (3, "done", None, 30)]
    assert [(k, t) for _, k, t, _ in got["overlay"] if k == "status"] == [("status", "capturing"), ("status", "answering"), ("status", "capturing")]
    assert [k for _, k, _, _ in got["overlay"] if k == "item"] == ["item"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [r.asDict() for r in _log(spark).where("session is not null and seq is not null").collect()] + [r.asDict() for r in _control(spark).collect()]
    (tmp_path / "in").mkdir()
    for part in range(2):  # two micro-batches: a session's earlier events first
        lines = [json.dumps(r) for r in rows if (r["seq"] >= 4) == bool(part)]
        (tmp_path / "in" / f"{part}.json").write_text("\n".join(lines))
        os.utime(tmp_path / "in" / f"{part}.json", (1000 + part, 1000 + part))  # files come in order of their time
    source = spark.readStream.schema(wire.EVENT_LOG).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = fold.to_files(fold.fold(source), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(240)
    written = spark.read.schema(fold.OUT).parquet(str(tmp_path / "out"))
    log = _log(spark).unionByName(_control(spark))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(fold.visible(written)) == key(feed.feed(status.heard(log), stamp="ts_ms").select("session", "seq", "question", "answer", "ts_ms"))
    assert key(fold.statuses(written).drop("ts_ms")) == key(status.timeline(log))
    shown = {r["session"]: (r["transcript"], r["status"]) for r in fold.now(written).collect()}
    assert {s: t for s, (t, _) in shown.items() if s in TRACES} == {s: live for s, (_, _, live) in TRACES.items()}
    assert shown["calls"] == ("STT error: lost", "error")


def test_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"Results","channel":{"alternatives":[{"transcript":"hi"}]},"is_final":true}\n{"type":"Metadata"}\n')
    got = []
    sinks = [lambda df: got.append(("one", [r["text"] for r in df.collect()])), lambda df: got.append(("two", df.count()))]
    fold.to_sinks(fold.transcripts(wire.messages(spark, str(tmp_path / "in"), streaming=True)), sinks, str(tmp_path / "cp")).awaitTermination(120)
    assert got == [("one", ["hi"]), ("two", 1)]
