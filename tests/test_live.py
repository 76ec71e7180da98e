"""Streams out of order, restarts, the ledger and the spool."""

import json
import os
import random
from datetime import datetime, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skeinflow.operators import answers, feed
from skeinflow.plans import live
from skeinflow.sources import spool, wire
from skeinflow.streaming import asof, fold, ledger, ordering

MINUTE = 60_000


def _put(spark, path, rows):
    spark.createDataFrame(rows, wire.EVENT_LOG).coalesce(1).write.mode("append").json(path)


def _stream(spark, path):
    return spark.readStream.schema(wire.EVENT_LOG).option("maxFilesPerTrigger", 1).json(path)


def _run(rows, folder):
    fold.to_files(rows, f"{folder}/out", f"{folder}/at").awaitTermination(240)


def test_rows_out_of_order(spark, tmp_path):
    """Rows wait for their turn, come once, and those behind the watermark are told of."""
    t, at = str(tmp_path), lambda m: 10**9 + m * MINUTE
    _put(spark, f"{t}/in", [("a", 3, "chunk", "A", at(3)), ("a", 1, "final", "what is x", at(1))])
    _put(spark, f"{t}/in", [("a", 2, "interim", "hm", at(2)), ("b", 1, "final", "why is y", at(30)), ("a", 2, "interim", "hm", at(2)), (None, 1, "done", None, at(1)), ("a", None, "done", None, at(1))])
    _put(spark, f"{t}/in", [("a", 4, "done", None, at(4)), ("a", 5, "chunk", "B", at(31)), ("b", 2, "chunk", "C", at(32))])
    _put(spark, f"{t}/in", [("b", 4, "clear", None, at(34)), ("b", 3, "done", None, at(33)), ("b", 5, "chunk", "D", at(33)), ("", 0, "beat", None, at(500))])
    _run(fold.fold_in_order(_stream(spark, f"{t}/in"), "10 minutes"), t)
    got = {(r["session"], r["seq"], r["kind"], r["text"]) for r in spark.read.schema(fold.OUT).parquet(f"{t}/out").collect()}
    assert got == {("a", 1, "final", "what is x"), ("a", 2, "interim", "hm"), ("a", 3, "chunk", "A"), ("a", 4, "late", None), ("a", 5, "chunk", "B"), ("b", 1, "final", "why is y"), ("b", 2, "chunk", "C"), ("b", 3, "done", None), ("b", 3, "item", None), ("b", 3, "status", "capturing"), ("b", 4, "clear", None), ("b", 5, "chunk", "D")}
    now = {r["session"]: (r["question"], r["draft"], r["transcript"], r["status"]) for r in fold.state(spark, f"{t}/at", in_order=True).collect()}
    assert now == {"a": ("what is x", "AB", "hm", "idle"), "b": ("why is y", "D", "", "capturing"), "": ("", "", "", "idle")}


def test_state_of_idle_sessions_goes(spark, tmp_path):
    t = str(tmp_path)
    _put(spark, f"{t}/in", [("a", 1, "final", "what is x", MINUTE), ("b", 1, "final", "why is y", 90 * MINUTE)])
    _put(spark, f"{t}/in", [("c", 1, "final", "how is z", 120 * MINUTE)])
    _put(spark, f"{t}/in", [("", 0, "beat", None, 140 * MINUTE)])
    _run(fold.fold_in_order(_stream(spark, f"{t}/in"), "5 minutes", idle_ms=60 * MINUTE), t)
    assert {r["session"] for r in fold.state(spark, f"{t}/at", in_order=True).collect()} == {"b", "c", ""}
    assert spark.read.schema(fold.OUT).parquet(f"{t}/out").where("kind = 'final'").count() == 3


def test_fold_tells_of_rows_that_fall_back(spark, tmp_path):
    t = str(tmp_path)
    _put(spark, f"{t}/in", [("a", 1, "final", "what is x", 1), ("a", 5, "chunk", "A", 5)])
    _put(spark, f"{t}/in", [("a", 3, "clear", None, 3), ("a", 5, "chunk", "A", 5), ("a", 6, "done", None, 6)])
    _run(fold.fold(_stream(spark, f"{t}/in")), t)
    got = [(r["seq"], r["kind"], r["answer"]) for r in spark.read.schema(fold.OUT).parquet(f"{t}/out").orderBy("seq", "kind").collect()]
    assert got == [(1, "final", None), (3, "late", None), (5, "chunk", None), (5, "late", None), (6, "done", None), (6, "item", "A"), (6, "status", None)]


def test_topics_on_two_streams(spark, tmp_path):
    """A change that comes after a question but was made before it counts; one behind the watermark doesn't."""
    t, at = str(tmp_path), lambda m: 10**9 + m * MINUTE
    _put(spark, f"{t}/q", [("s", 2, "", "q2", at(2)), ("s", 6, "", "q6", at(6))])
    _put(spark, f"{t}/q", [("s", 40, "", "q40", at(40)), ("u", 41, "", "q41", at(40))])
    _put(spark, f"{t}/q", [("s", 3, "", "q3", at(3)), ("", 0, "", "", at(900))])
    _put(spark, f"{t}/c", [("s", 6, "", "t6", at(6)), ("s", 9, "", "t9", at(9))])
    _put(spark, f"{t}/c", [("s", 1, "", "t1", at(1)), ("s", 50, "", "t50", at(50))])
    _put(spark, f"{t}/c", [("s", 30, "", "t30", at(20)), ("", 1, "", "", at(900))])
    _run(asof.as_of(_stream(spark, f"{t}/q"), _stream(spark, f"{t}/c"), "10 minutes"), t)
    got = {(r["text"], r["value"], r["late"]) for r in spark.read.schema(asof.OUT).parquet(f"{t}/out").where("session <> ''").collect()}
    assert got == {("q2", "t1", False), ("q6", "t6", False), ("q40", "t9", False), ("q41", None, False), ("q3", None, True), ("t30", None, True)}


def test_any_order_gives_the_same(spark, tmp_path):
    """Rows of many sessions, shuffled within the delay over micro-batches, some of them twice."""
    rng, rows = random.Random(2), []
    for s in "abcdef":
        for i in range(60):
            kind = rng.choice(["final", "chunk", "chunk", "done", "interim", "clear", "start", "stop", "audio"])
            rows.append((s, i, kind, f"what is {i}", 10**9 + i * MINUTE))
    order = sorted(rows, key=lambda r: r[4] + rng.randrange(9 * MINUTE)) + rows[-40:]
    t = str(tmp_path)
    for part in range(4):
        _put(spark, f"{t}/in", order[part * 100 : (part + 1) * 100])
    _put(spark, f"{t}/in", [("", 0, "beat", None, 10**9 + 900 * MINUTE)])
    _run(fold.fold_in_order(_stream(spark, f"{t}/in"), "20 minutes"), t)
    _put(spark, f"{t}/whole", rows)
    _run(fold.fold(_stream(spark, f"{t}/whole")), f"{t}/w")
    key = lambda df: sorted(map(str, df.where("kind <> 'late'").collect()))
    got, want = (spark.read.schema(fold.OUT).parquet(p) for p in (f"{t}/out", f"{t}/w/out"))
    assert key(got) == key(want) and len(key(want)) > 300


def test_once(spark, tmp_path):
    t = str(tmp_path)
    for _ in range(2):
        _put(spark, f"{t}/in", [("a", 1, "final", "what is x", 1000), ("a", 2, "chunk", "A", 2000), ("a", 2, "chunk", "A", 2000)])
    _run(ordering.once(_stream(spark, f"{t}/in")), t)
    assert sorted(r["seq"] for r in spark.read.parquet(f"{t}/out").collect()) == [1, 2]


def test_requests_are_asked_once(spark, tmp_path):
    """A sink that fails makes the batch run again: its answers are in the ledger."""
    t, calls, broken = str(tmp_path), spark.sparkContext.accumulator(0), [True]

    def provider(request):
        calls.add(1)
        yield request.question
        if request.question == "q3":
            raise ConnectionError("lost")

    def sink(rows):
        got = rows.count()
        if broken[0] and got:
            raise OSError("no room")

    def requests():
        return _stream(spark, f"{t}/in").selectExpr("session", "seq", "'' as topic", "'' as template", "text as question")

    _put(spark, f"{t}/in", [("s", i, "final", f"q{i}", i) for i in range(5)])
    with pytest.raises(Exception, match="no room"):
        ledger.to_ledger(requests(), f"{t}/ledger", f"{t}/at", provider, [sink]).awaitTermination(120)
    broken[0] = False
    _put(spark, f"{t}/in", [("s", i, "final", f"q{i}", i) for i in range(5, 8)])
    ledger.to_ledger(requests(), f"{t}/ledger", f"{t}/at", provider, [sink]).awaitTermination(120)
    got = ledger.read(spark, f"{t}/ledger")
    assert calls.value == 8 and sorted(r["chunk"] for r in got.where("chunk is not null").collect()) == [f"q{i}" for i in range(8)]
    assert [r["failure"] for r in got.where("failure is not null").collect()] == ["lost"]
    log = answers.log(spark.createDataFrame([("s", i, f"q{i}") for i in range(8)], "session string, seq long, text string"), got, ["seq"])
    assert feed.feed(log, ["seq", "step"]).count() == 7


def test_a_conversation_asks_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def provider(request):
        calls.add(1)
        yield request.question

    finals = spark.createDataFrame([("s", i, f"what is {i}") for i in range(20)], "session string, seq int, text string")
    requests = finals.selectExpr("session", "seq", "'' as topic", "'' as template", "text as question")
    rows = feed.feed(answers.conversation(finals, requests, ["seq"], provider), ["seq", "step"])
    assert rows.count() == rows.count() == 20 and calls.value == 20


def test_spool(spark, tmp_path):
    """Epochs in, epochs out; a batch that is run again after its commit got lost adds nothing; files without a manifest don't count."""
    t = str(tmp_path)
    spool.register(spark)
    spool.register(spark)
    kind = "id long, text string"

    def put(ids):
        spark.createDataFrame([(i, f"t{i}") for i in ids], kind).repartition(2).write.format("spool").mode("append").save(f"{t}/in")

    def go():
        rows = spark.readStream.format("spool").schema(kind).load(f"{t}/in").withColumn("text", F.upper("text"))
        rows.writeStream.format("spool").option("checkpointLocation", f"{t}/at").trigger(availableNow=True).start(f"{t}/out").awaitTermination(120)
        return sorted(r["id"] for r in spark.read.format("spool").schema(kind).load(f"{t}/out").collect())

    put(range(10))
    assert go() == list(range(10))
    put(range(10, 15))
    put([])
    assert go() == list(range(15))
    last = max(int(n) for n in os.listdir(f"{t}/at/commits") if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{t}/at/commits/{name}")
    put([15])
    assert go() == list(range(15))  # the batch that is run again; what came since is the next run's
    assert go() == list(range(16)) and go() == list(range(16))
    spool.Folder(f"{t}/out").write(iter(spark.createDataFrame([(99, "x")], kind).toArrow().to_batches()))
    assert go() == list(range(16))
    assert {r["text"] for r in spark.read.format("spool").schema("text string").load(f"{t}/out").collect()} == {f"T{i}" for i in range(16)}
    assert json.loads(open(f"{t}/out/epochs/000000000000.json").read())


def test_caller_settings_stay(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    own = live.session(spark)
    own.conf.set("spark.sql.shuffle.partitions", "3")
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and datetime.fromtimestamp(0, timezone.utc).year == 1970


class _Handle:
    """One session's value and timers, and the number of calls: each is a message between processes."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = tuple(value)

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


def test_state_is_read_and_written_once(spark):
    """However many rows wait, a batch costs a session a few calls and one timer; rows come out once and in order."""
    handle, rng, got, passed = _Handle(), random.Random(5), [], 0
    processor = ordering.InOrder(asof.STEP, idle_ms=5000)
    processor.init(handle)
    make, numbers = Row("session", "seq", "ts_ms", "kind", "text"), list(range(1, 3001))
    order = sorted(numbers, key=lambda n: n + rng.randrange(900))
    for at in range(0, 3000, 300):
        handle.calls, some = 0, order[at : at + 300]
        times = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed)
        got += processor.handleInputRows(("s",), iter([make("s", n, n, "row", f"t{n}") for n in some + some[:5]]), times)
        for due in [t for t in handle.timers if t <= passed]:
            got += processor.handleExpiredTimer(("s",), times, SimpleNamespace(getExpiryTimeInMs=lambda due=due: due))
            handle.timers.discard(due)
        assert handle.calls <= 5 and len(handle.timers) == 1
        passed = max(order[: at + 300]) - 901
    for passed in (4000, 9000):
        due = handle.timers.pop()
        got += processor.handleExpiredTimer(("s",), SimpleNamespace(getCurrentWatermarkInMs=lambda: passed), SimpleNamespace(getExpiryTimeInMs=lambda: due))
    assert [r["seq"] for r in got] == numbers and not any(r["late"] for r in got)
    assert handle.value is None and not handle.timers


def test_large_streams_have_more_files_and_parts(spark):
    """Rows by task don't grow with the input, neither of files nor of state."""
    assert live.files(1000, 3) == live.FILES and live.files(60_000_000, 3) >= 60
    own = live.session(spark, 60_000_000)
    assert int(own.conf.get("spark.sql.shuffle.partitions")) >= 60
    assert int(live.session(spark, 1000).conf.get("spark.sql.shuffle.partitions")) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_the_last_beat_comes_with_the_last_rows(spark, tmp_path):
    rows = spark.range(90).selectExpr("'s' as session", "id as seq", "'row' as kind", "'t' as text", "id as ts_ms")
    live.deliver(rows, F.floor(F.col("seq") / 30).cast("int"), 3, f"{tmp_path}/in", 4, live.beat(spark, 1000))
    files = spark.read.schema(wire.EVENT_LOG).json(f"{tmp_path}/in").withColumn("file", F.input_file_name())
    last = {r["file"] for r in files.where("seq >= 60 and kind = 'row'").collect()}
    assert files.select("file").distinct().count() == 12 and {r["file"] for r in files.where("session = ''").collect()} <= last
