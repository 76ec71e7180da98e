"""Runs by the automaton against their definition, and the query's rows against plain Python."""

import hashlib
import random
import re
import zlib

from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from skeinflow.llm import periodic_runs


def plain(words, least=12):
    """Runs by definition: stretches of equal words a period apart, whose smallest period that is."""
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                part = words[i : i + length]
                if all(any(part[k] != part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1 if j > i else i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@hyp(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=90), st.integers(1, 6))
def test_small_alphabets(k, word, least):
    word = [w % k for w in word]
    assert periodic_runs.runs(word, 2 * least) == plain(word, 2 * least)


def test_periodic_and_nested():
    a = [0, 1, 0, 0, 1]
    for word in (a * 9, [7] * 50, (a * 3 + [5]) * 4, [1, 2] * 20 + [1, 1] * 20, list(range(30)) * 2 + list(range(10)) * 3):
        assert periodic_runs.runs(word) == plain(word)
    fib = [0], [0, 1]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    assert periodic_runs.runs(fib[1]) == plain(fib[1])


def test_long():
    word = list(range(7)) * 30_000
    assert periodic_runs.runs(word) == [(0, 210_000, 7)]
    assert periodic_runs.runs([3] * 100_000) == [(0, 100_000, 1)]
    assert periodic_runs.runs(list(range(100_000)) * 2 + [0, 1, 3]) == [(0, 200_002, 100_000)]


def _row(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    found = plain(words)
    gone = {k for s, length, p in found for k in range(s + p, s + length)}
    best = min(((-length, s, p) for s, length, p in found), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    top = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (i, len(found), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_query_on_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a " * 11, "a " * 12, "a\u00a0b ", "a b " * 15, "x y\x0bz " * 9, "é ü\n" * 20, "one two three four five six " * 2]
    for _ in range(60):
        parts = [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 9))) for _ in range(3)]
        texts.append("\n".join(rng.choice(parts) for _ in range(rng.randrange(30))))
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[7]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i is not None)
    got = sorted((tuple(r) for r in periodic_runs.report(periodic_runs.looped(df)).collect()), key=str)
    assert got == sorted((_row(i, t) for i, t in rows), key=str)


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000")
    got = sorted((tuple(r) for r in periodic_runs.report(periodic_runs.looped(docs)).collect()), key=str)
    assert got == sorted((_row(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=str)
    assert sum(r[1] for r in got) > 10


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "a b " * 10, "x", 5)], "doc_id long, text string, runs string, _got int").withColumns({"_words": F.lit("mine"), "_loop": F.lit(1)})
    got = periodic_runs.periodic(periodic_runs.looped(df))
    assert got.columns == ["doc_id", "text", "_got", "_words", "_loop", "runs", "collapsed"] and got.first()["_words"] == "mine"
    assert [tuple(r) for r in got.first()["runs"]] == [(0, 20, 2)] and got.first()["collapsed"] == "a b"
    assert periodic_runs.report(df.limit(0)).count() == 0
