"""Golden arrays of the audio operators, and a plain rendering of both resamplers."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import audio
from skeinflow.sources import wire

CASES = [
    ([0.5] * 3 + [-1.0] * 3 + [2.0] * 3 + [0.9], 48000, [16383, -32768, 32767], [16383, -32768, 32767]),
    ([], 48000, [], []),
    ([1.0], 48000, [32767], []),
    ([0.5, -0.5], 8000, [0, 16383, 0, -16384], [16383, -16384]),
    ([math.nan] * 3, 48000, [0], [0]),
]


def _run(spark, samples, column):
    return spark.createDataFrame([(samples,)], "a array<float>").select(column).first()[0]


@pytest.mark.parametrize(("samples", "rate", "capture", "worklet"), CASES)
def test_golden(spark, samples, rate, capture, worklet):
    assert _run(spark, samples, audio.capture(F.col("a"), rate)) == capture
    assert _run(spark, samples, audio.worklet(F.col("a"), rate)) == worklet


def _plain(x, rate, rounded):
    import numpy as np

    ratio = rate / 16000
    edge = (lambda i: min(len(x), math.floor(i * ratio + 0.5))) if rounded else (lambda i: min(len(x), math.floor(i * ratio)))
    n = math.floor(len(x) / ratio) if rounded else max(1, math.floor(len(x) / ratio))
    out = []
    for i in range(n if x else 0):
        part = x[edge(i) : edge(i + 1)]
        m = sum(part) / len(part) if part else 0.0
        m = float(np.float32(m)) if rounded else m
        c = max(-1.0, min(1.0, m))
        out.append(int(c * 32768 if c < 0 else c * 32767))
    return out


@pytest.mark.parametrize("rate", [48000, 44100, 22050])
def test_against_plain(spark, rate):
    import numpy as np

    rng = random.Random(rate)
    blocks = [[float(np.float32(rng.uniform(-2, 2))) for _ in range(rng.randrange(0, 60))] for _ in range(30)]
    rows = spark.createDataFrame(list(enumerate(blocks)), "id int, a array<float>")
    got = {r["id"]: (r["c"], r["w"]) for r in rows.select("id", audio.capture(F.col("a"), rate).alias("c"), audio.worklet(F.col("a"), rate).alias("w")).collect()}
    for i, x in enumerate(blocks):
        assert got[i] == (_plain(x, rate, False), _plain(x, rate, True))


def test_null_block(spark):
    assert _run(spark, None, audio.capture(F.col("a"))) == [] and _run(spark, None, audio.worklet(F.col("a"))) == []


def test_bytes(spark):
    rows = spark.createDataFrame([(bytes.fromhex("0100FFFF00"),), (b"",), (b"\x01",), (None,)], "data binary")
    assert [r["samples"] for r in wire.sound(rows).collect()] == [[1, -1]]
    back = rows.limit(1).select(audio.to_bytes(audio.from_bytes(F.col("data")))).first()[0]
    assert bytes(back) == bytes.fromhex("0100FFFF")


def test_blocks(spark):
    rows = spark.createDataFrame([([[0.5] * 3, [1.0] * 3],), ([],), (None,), ([[]],)], "channels array<array<float>>")
    assert [r["pcm"] for r in wire.blocks(rows).collect()] == [[16383]]
