"""Near duplicates against brute force, and the sketches that rule pairs out."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import near_duplicates as nd


def _texts(seed: int, n: int = 90):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 40)))) for i in range(n, n + 20)]
    return [*docs, (500, None), (501, ""), (502, "  \n"), (503, docs[3][1]), (None, docs[3][1]), (504, "only three words"), (505, "only three words")]


def _brute(docs):
    rows = [(k, i, t) for k, (i, t) in enumerate(docs)]
    root = {k: k for k, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, _, x), (b, _, y) in itertools.combinations(rows, 2):
        if (x or "").split() and (x == y or nd.jaccard(x, y) >= nd.SIMILAR):
            root[find(b)] = find(a)
    groups = {}
    for k, i, _ in rows:
        groups.setdefault(find(k), []).append(i)
    return sorted(sorted(map(str, g)) for g in groups.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_classes(spark, seed):
    docs = _texts(seed)
    got = nd.classes(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string")).collect()
    assert all(r["lang"] == "x" for r in got)
    by = {}
    for r in got:
        by.setdefault(r["class_id"], []).append(r["doc_id"])
        assert r["n_in_class"] >= 1
    assert sorted(sorted(map(str, g)) for g in by.values()) == _brute(docs)


def test_one_stays(spark):
    docs = _texts(3)
    rows = spark.createDataFrame([(*d, "x", 1) for d in [*docs, docs[0]]], "doc_id long, text string, lang string, n long")
    kept = nd.keep_one(rows)
    assert kept.columns == rows.columns
    groups = _brute(docs)
    ids = {str(r["doc_id"]) for r in kept.collect()}
    assert kept.count() == len(groups) and all(len(ids & set(g)) == 1 for g in groups)


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert nd.classes(rows).count() == nd.keep_one(rows).count() == 0


def test_same_dart_as_often_as_similar():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
    h = np.concatenate([both, one, both, two])
    doc = np.repeat([0, 1], 80)
    sig = nd.darts(doc, h, np.ones(160), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.04


def test_weights_count():
    h = np.array([1, 2, 1, 2], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sig = nd.darts(np.array([0, 0, 1, 1]), h, np.array([3.0, 1.0, 1.0, 3.0]), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - 2 / 6) < 0.04


def test_sketches_never_lose_a_pair(spark):
    rng = np.random.default_rng(1)
    rows, want = [], set()
    for i in range(60):
        both = rng.integers(0, 2**63, int(rng.integers(0, 200))).astype(np.uint64)
        a, b = (np.concatenate([both, rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)]) for _ in "ab")
        h, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        bits = nd.sketches(doc, h, np.ones(len(h)), 2)
        rows.append((i, (len(a), bits[0].tolist()), (len(b), bits[1].tolist())))
        if len(a) + len(b) and len(both) / (len(a) + len(b) - len(both)) >= 0.8:
            want.add(i)
    df = spark.createDataFrame(rows, "i int, x struct<n: long, bits: array<long>>, y struct<n: long, bits: array<long>>")
    got = {r["i"] for r in df.where(nd.near("x", "y", 0.8)).collect()}
    assert want and want <= got and len(got) < 60


def test_components(spark):
    from skeinflow.llm.common import components

    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_bucket_gives_few_pairs(spark):
    """A group of texts that are all somewhat alike: the sketches leave hardly a pair to compare."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    docs = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), 7):
            words[at] = f"x{rng.randrange(10**9)}"
        docs.append((i, " ".join(words)))
    got = nd.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.select("class_id").distinct().count() == 150 and got.where(F.col("n_in_class") > 1).isEmpty()


def test_signatures_cost_less_than_sorting_their_darts():
    rng = np.random.default_rng(4)
    docs, k = 800, 36
    doc, h = np.repeat(np.arange(docs), 20), rng.integers(0, 2**63, docs * 20).astype(np.uint64)
    n = int(docs * (k * np.log(k) + 2 * k))
    place, rank, dart = rng.integers(0, docs * k, n), rng.random(n), rng.integers(0, 2**63, n).astype(np.uint64)

    def seconds(work):
        t = time.thread_time()
        work()
        return time.thread_time() - t

    signed = min(seconds(lambda: nd.darts(doc, h, np.ones(len(h)), docs, k)) for _ in range(7))
    assert signed < min(seconds(lambda: np.lexsort((dart, rank, place))) for _ in range(7))


def test_a_union_keeps_the_lower_darts_of_its_sets():
    rng = np.random.default_rng(6)
    for weights in (np.ones(90), rng.integers(1, 6, 90).astype(float), rng.random(90) * 3):
        h = rng.integers(0, 2**63, 90).astype(np.uint64)
        doc = np.concatenate([np.zeros(50, int), np.ones(40, int), np.full(90, 2)])
        rank, found = nd._throw(doc, np.concatenate([h, h]), np.concatenate([weights, weights]), np.full(3, 6.0), 3, 48)
        first = rank[0] <= rank[1]
        assert np.isfinite(rank[2]).any() and (rank[2] == np.where(first, rank[0], rank[1])).all()
        assert (found[2] == np.where(first, found[0], found[1])).all()
