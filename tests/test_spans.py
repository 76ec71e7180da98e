"""Blocks, spans, sessions, newest items and latencies against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from skeinflow.operators import blocking, feed, intervals, latency, ordered, status
from skeinflow.streaming import blocking as stream_blocking
from skeinflow.streaming import fold

from .test_live import _put  # noqa: F401


@pytest.mark.parametrize("frames, size", [(5, 3), (8, 1), (4096, 100)])
def test_packed(spark, frames, size):
    rng, rows, whole = random.Random(frames), [], {}
    for s in "ab":
        for i in range(60):
            run = [float(rng.randrange(1000)) for _ in range(rng.choice([0, 1, 3, 17]))]
            rows.append((s, i, run or rng.choice([[], None])))
            whole.setdefault(s, []).extend(run)
    rows += [(None, 1, [1.0]), ("a", None, [1.0])]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session string, seq long, samples array<float>")
    got = {(r["session"], r["block"]): r["samples"] for r in blocking.packed(df, block=ordered.by_number("seq", size), frames=frames, rest=True).collect()}
    assert got == {(s, k): w[k * frames : (k + 1) * frames] for s, w in whole.items() for k in range(-(-len(w) // frames))}
    full = blocking.packed(df, block=ordered.by_number("seq", size), frames=frames)
    assert full.count() == sum(len(w) // frames for w in whole.values()) and blocking.packed(df.limit(0)).count() == 0


def test_packed_stream(spark, tmp_path):
    """Runs in two micro-batches, out of order; what is left over waits."""
    t, kind = str(tmp_path), stream_blocking.RUNS
    runs = [("a", i, [float(10 * i + k) for k in range(i % 4)], 1000 + i) for i in range(20)]
    for part in (runs[8:12] + runs[:8], runs[12:], [("", 0, None, 10**7)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(f"{t}/in")
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(f"{t}/in")
    fold.to_files(stream_blocking.packed(source, 7, "1 second"), f"{t}/out", f"{t}/at").awaitTermination(240)
    whole = [x for _, _, run, _ in runs for x in run]
    got = {r["block"]: r["samples"] for r in spark.read.schema(stream_blocking.OUT).parquet(f"{t}/out").where("not late").collect()}
    assert got == {k: whole[7 * k : 7 * k + 7] for k in range(len(whole) // 7)}


@pytest.mark.parametrize("width, hot", [(1, 10**6), (7, 3), (1000, 5)])
def test_inside(spark, width, hot):
    rng = random.Random(width)
    points = [(rng.choice("ab"), i, rng.choice([None, -3, *range(60)])) for i in range(200)] + [("a", 200 + i, 30) for i in range(100)] + [(None, 400, 5)]
    spans = [(rng.choice("ab"), 1000 + i, s, s + rng.choice([-1, 0, 1, 5, 20])) for i, s in enumerate(rng.choices(range(-5, 60), k=40))] + [("a", 2000, None, 5), (None, 2001, 0, 50)]
    got = intervals.inside(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(spans, "k string, s long, lo long, hi long"), ["k"], "at", "lo", "hi", width, hot)
    assert got.columns == ["k", "p", "at", "s", "lo", "hi"] and "NestedLoop" not in got._jdf.queryExecution().toString()
    want = sorted((p, s) for k, p, at in points for k2, s, lo, hi in spans if k is not None and k == k2 and at is not None and lo is not None and lo <= at < hi)
    assert sorted((r["p"], r["s"]) for r in got.collect()) == want and len(want) > 100


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_sessions(spark, size):
    rng, rows, want = random.Random(size), [], []
    for k in "ab":
        at, start, n = 0, None, 0
        for i in range(80):
            step = rng.choice([0, 1, 4, 5, 6, 30])
            if start is None or step >= 5:
                if start is not None:
                    want.append((k, start, at + 5, n))
                start, n = at + step, 0
            at, n = at + step, n + 1
            rows.append((k, i, at))
        want.append((k, start, at + 5, n))
    rows += [(None, 1, 1), ("a", 900, None)]
    rng.shuffle(rows)
    got = intervals.sessions(spark.createDataFrame(rows, "k string, seq long, at long"), ["k"], "at", 5, ["at", "seq"], ordered.by_number("at", size))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_newest(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, f"q{i}") for i in range(300)] + [(None, 1, "x"), ("a", None, "x")]
    got = feed.newest(spark.createDataFrame(rows, "session string, seq long, question string"), 4, block=ordered.by_number("seq", 7))
    want = sorted((s, i, k + 1) for s in "abc" for k, i in enumerate(sorted((i for t, i, _ in rows if t == s and i is not None), reverse=True)[:4]))
    assert sorted((r["session"], r["seq"], r["place"]) for r in got.collect()) == want
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_quantiles_are_within_their_error(spark):
    """Every level comes from the finest cells; each quantile is within the error of the exact one."""
    rng = random.Random(9)
    rows = [(rng.choice(["x", "y", None]), rng.randrange(5), int(rng.lognormvariate(8, 3)) if rng.random() < 0.95 else rng.choice([0, None, -1])) for _ in range(3000)]
    cells = latency.cells(spark.createDataFrame(rows, "a string, b int, v long"), ["a", "b"], "v")
    got = latency.quantiles(latency.merged(cells.withColumn("f", F.lit(1)), ["f"], ["a", "b"]), ["f", "a", "b", "level"], {"half": (1, 2), "top": (99, 100)}).collect()
    assert {r["level"] for r in got} == {0, 1, 2} and len(got) == 1 + 3 + 15
    for r in got:
        own = sorted(max(v, 0) for a, b, v in rows if v is not None and (r["level"] < 1 or a == r["a"]) and (r["level"] < 2 or b == r["b"]))
        assert r["n"] == len(own)
        for name, share in (("half", 0.5), ("top", 0.99)):
            exact = own[math.ceil(share * len(own) - 1e-9) - 1]
            assert abs(r[name] - exact) <= latency.ERROR * (exact + 1) + 0.5 + 1e-6, (r, exact)


def test_no_join_by_session_alone(spark):
    log = spark.createDataFrame([("s", i, k, None) for i, k in enumerate(["start", "keys", "final", "stop", "start"])], "session string, seq long, kind string, text string")
    plan = status.activity(log)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and all(re.search(r"_block#\d+L? = _b#\d+", x) for x in joins)
