"""The language model against a plain one without buckets, ids and exchanges; its seating; odd and long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import pitman_yor as py
from skeinflow.llm.common import mix

SCHEMA = "doc_id long, text string"


def _plain(docs):
    """Scores by id, from dictionaries of all pairs."""
    texts = {}
    for i, t in docs:
        (_, _, h, _), = py._tokens(pa.array([t], pa.string()))
        words = [int(x) for x in h]
        texts[i] = list(zip([int(py.END), *words[:-1]], words, strict=True))
    count, pairs = {}, {}
    for i, own in texts.items():
        if not py.held_out(i):
            for ctx, w in own:
                pairs[ctx, w] = pairs.get((ctx, w), 0) + 1
                count[w] = count.get(w, 0) + 1
    v, keys = len(count), sorted(pairs)
    c = np.array([pairs[k] for k in keys])
    own = {w: mix(np.array([w], np.uint64))[0] for w in {x for k in keys for x in k}}
    with np.errstate(over="ignore"):
        rng = mix(np.array([own[w] + own[u] * np.uint64(3) for u, w in keys], np.uint64))
    words = sorted(count)
    word_rng = np.array([own[w] for w in words], np.uint64)

    def sums(t, side):
        out = {}
        for k, x in zip(keys, t, strict=True):
            out[k[side]] = out.get(k[side], 0) + x
        return out

    t = np.minimum(c, 1).astype(float)
    dishes = sums(t, 1)
    dish_t = {w: 1.0 for w in words}
    one = lambda xs: py._discount(sum(x == 1 for x in xs), sum(x == 2 for x in xs))
    d = one(c.tolist()), one(dishes.values())
    customers = {}
    for (u, _), x in pairs.items():
        customers[u] = customers.get(u, 0) + x
    base, scores = 1 / (v + 1), []

    def parent(w, all_c, all_t):
        return (max(dishes.get(w, 0) - d[1] * dish_t.get(w, 0), 0) + (py.THETA + d[1] * all_t) * base) / (py.THETA + all_c)

    for i in range(py.SWEEPS + 1):
        tables, all_c, all_t = sums(t, 0), t.sum(), sum(dish_t.values())
        if i > py.SWEEPS - py.KEPT:
            own_t = dict(zip(keys, t.tolist(), strict=True))
            p = lambda u, w: (max(pairs.get((u, w), 0) - d[0] * own_t.get((u, w), 0), 0) + (py.THETA + d[0] * tables.get(u, 0)) * parent(w, all_c, all_t)) / (py.THETA + customers.get(u, 0))  # noqa: E731, B023
            scores.append({k: p(*k) for own_ in texts.values() for k in own_})
        if i == py.SWEEPS:
            break
        others = np.array([tables[u] for u, _ in keys]) - t
        t = py.seat(c, others, np.array([parent(w, all_c, all_t) for _, w in keys]), d[0], rng + np.uint64(i + 1))
        dishes = sums(t, 1)
        got = py.seat(np.array([dishes[w] for w in words]).astype(np.int64), all_t - np.array([dish_t[w] for w in words]), np.full(len(words), base), d[1], word_rng + np.uint64(i + 1))
        dish_t = dict(zip(words, got.tolist(), strict=True))
    return {i: sum(np.log10(sum(s[k] for s in scores) / py.KEPT) for k in own_) for i, own_ in texts.items()}, len(count)


def _corpus(rng, n, rare):
    follows = {f"t{i}": [f"t{rng.randrange(80)}" for _ in range(3)] for i in range(80)}
    out = []
    for i in range(n):
        w, text = f"t{rng.randrange(80)}", []
        for _ in range(60):
            text.append(w)
            w = rng.choice(follows[w])
            if rare:
                text += [f"r{rng.randrange(rare)}" for _ in range(8)]
        out.append((i, " ".join(text)))
    return out


@pytest.mark.parametrize("n,rare", [(60, 0), (260, 120_000)])
def test_against_plain(spark, n, rare):
    """Also with more words than the head has: those outside it are contexts of their own."""
    docs = [*_corpus(random.Random(n), n, rare), (9000, None), (9001, ""), (9002, "never seen words"), (9003, "T1 t2")]
    want, v = _plain(docs)
    assert v > py.HEAD or not rare
    rows = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", h string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in py.score(rows).collect()}
    assert got.keys() == want.keys()
    for i, x in want.items():
        assert abs(got[i] - x) < 1e-6 * max(1, abs(x))


def _gibbs(docs, sweeps, burn):
    """Scores by id from one-by-one Gibbs sampling: each customer leaves its table and is seated anew, tables being customers of
    the parent. Nothing of the module's sampler is used."""
    rng, end = random.Random(1), "</s>"
    texts = {i: [(u, w) for u, w in zip([end, *t.split()], [*t.split(), end], strict=True)] for i, t in docs}
    train = [k for i, own in texts.items() for k in own if not py.held_out(i)]
    words = {w for _, w in train}
    share = lambda xs: min(0.95, max(0.05, sum(x == 1 for x in xs) / max(1, sum(x == 1 for x in xs) + 2 * sum(x == 2 for x in xs))))
    pair_n = {k: train.count(k) for k in set(train)}
    d = share(list(pair_n.values())), share([sum(w == x for _, x in pair_n) for w in words])
    low, top = {}, {}  # sizes of tables by context and word; by word
    in_low, in_top = {}, [0, 0]  # by context: customers and tables; of the parent

    def p_top(w):
        own = top.get(w, [])
        return (sum(own) - d[1] * len(own) + (py.THETA + d[1] * in_top[1]) / (len(words) + 1)) / (py.THETA + in_top[0])

    def p_low(u, w):
        own, (c, t) = low.get((u, w), []), in_low.get(u, (0, 0))
        return (sum(own) - d[0] * len(own) + (py.THETA + d[0] * t) * p_top(w)) / (py.THETA + c)

    def sit(own, new, disc):
        """Whether a table is opened."""
        x = rng.random() * (sum(own) - disc * len(own) + new)
        for k, n in enumerate(own):
            x -= n - disc
            if x < 0:
                own[k] += 1
                return False
        own.append(1)
        return True

    def leave(own):
        """Whether a table is given up."""
        k = rng.choices(range(len(own)), weights=own)[0]
        own[k] -= 1
        if not own[k]:
            del own[k]
            return True
        return False

    def enter(u, w):
        c, t = in_low.get(u, (0, 0))
        opened = sit(low.setdefault((u, w), []), (py.THETA + d[0] * t) * p_top(w), d[0])
        in_low[u] = c + 1, t + opened
        if opened:
            more = sit(top.setdefault(w, []), (py.THETA + d[1] * in_top[1]) / (len(words) + 1), d[1])
            in_top[0], in_top[1] = in_top[0] + 1, in_top[1] + more

    for k in train:
        enter(*k)
    sums, kept = {k: 0.0 for own in texts.values() for k in own}, 0
    for i in range(sweeps):
        for u, w in train:
            gone = leave(low[u, w])
            c, t = in_low[u]
            in_low[u] = c - 1, t - gone
            if gone:
                less = leave(top[w])
                in_top[0], in_top[1] = in_top[0] - 1, in_top[1] - less
            enter(u, w)
        if i >= burn:
            kept += 1
            for k in sums:
                sums[k] += p_low(*k)
    return {i: (sum(np.log10(sums[k] / kept) for k in own), len(own)) for i, own in texts.items()}


def test_close_to_one_by_one_gibbs(spark):
    """Three parallel sweeps against forty sequential ones: scores by token are close, and rank texts alike."""
    docs = [*_corpus(random.Random(12), 70, 0), (9002, "never seen words"), (9003, "t1 t2 t1")]
    want = _gibbs(docs, 40, 10)
    got = {r["doc_id"]: r["score"] for r in py.score(spark.createDataFrame(docs, SCHEMA)).collect()}
    apart = [abs(got[i] - x) / n for i, (x, n) in want.items()]
    assert np.mean(apart) < 0.02 and max(apart) < 0.1
    assert np.corrcoef([got[i] / n for i, (_, n) in want.items()], [x / n for x, n in want.values()])[0, 1] > 0.98


def test_seating_in_blocks_is_close_to_one_by_one():
    """What README says of the normal shape: tables of many customers, in mean and spread."""
    keys = mix(np.arange(4000).astype(np.uint64))
    for c, others, p in ((500, 100.0, 0.02), (5_000, 2_000.0, 0.01), (5_000, 50_000.0, 1e-5)):
        fill = lambda x: np.full(len(keys), x)
        one, blocks = (py.seat(fill(c), fill(others), fill(p), 0.7, keys, one_by_one=x) for x in (10**9, py.ONE_BY_ONE))
        assert abs(blocks.mean() / one.mean() - 1) < 0.01 and abs(blocks.std() / one.std() - 1) < 0.1


def test_repeats_and_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(300_000))
    docs = [*_corpus(rng, 20, 0), (500, long), (500, long), (None, "t1"), (501, "x" * 10**6)]
    got = py.score(spark.createDataFrame(docs, SCHEMA)).collect()
    assert len(got) == len(docs) and sum(r["n_tokens"] == 300_001 for r in got) == 2
    assert all(r["score"] < 0 for r in got) and len({r["score"] for r in got if r["doc_id"] == 500}) == 1
    assert py.score(spark.createDataFrame([], SCHEMA)).count() == 0
    none = spark.createDataFrame([(i, "a b") for i in range(60) if py.held_out(i)], SCHEMA)
    assert py.score(none).where(F.col("train_tokens") == 0).count() == none.count()


def test_the_table_of_tokens_is_small(spark, monkeypatch):
    """Its files are there through all sweeps, so they are packed by zstd."""
    seen, sampled = [], py._sampled

    def spy(packed, *rest):
        seen.extend(packed.inputFiles())
        return sampled(packed, *rest)

    monkeypatch.setattr(py, "_sampled", spy)
    docs = spark.createDataFrame([(i, f"a b {i}") for i in range(20)], "doc_id long, text string")
    assert py.score(docs).count() == 20
    assert seen and all(".zstd." in f for f in seen)
