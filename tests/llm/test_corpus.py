"""Decontamination, repeated passages, the language model, page extraction and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinflow.llm import decontamination as dc
from skeinflow.llm import bpe, html, passages, quality_model
from skeinflow.llm import near_duplicates as nd
from skeinflow.llm import pitman_yor as py
from skeinflow.llm.common import table

from ..conftest import SF


def _words(rng, n, of=3000):
    return [f"w{rng.randrange(of)}" for _ in range(n)]


def _plain_align(item, text):
    best, above = 0, [0] * (len(text) + 1)
    for w in item:
        here = [0]
        for j, t in enumerate(text):
            here.append(max(0, above[j] + (dc.MATCH if t == w else dc.MISMATCH), above[j + 1] + dc.GAP, here[j] + dc.GAP))
        best, above = max(best, *here), here
    return best


def test_align():
    rng = random.Random(1)
    for _ in range(60):
        item, text = (np.array([rng.randrange(6) for _ in range(rng.randrange(0, 25))], dtype=np.int64) for _ in "ab")
        assert dc.align(item, text)[0] == _plain_align(item.tolist(), text.tolist())


def test_leaks(spark):
    rng = random.Random(2)
    items = [(i, " ".join(_words(rng, 40))) for i in range(5)] + [(5, "too short"), (6, None), (None, "no id has this item at all")]
    docs, want = [], set()
    for i in range(30):
        text = _words(rng, 200)
        if i % 3 == 0:
            k = rng.randrange(5)
            passage = items[k][1].split()
            for _ in range(5):  # edits: a word changed, dropped or put in
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
            text[100:100] = passage
            want.add((i, k))
        docs.append((i, " ".join(text).upper() if i % 6 == 0 else " ".join(text)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (92, items[0][1])]
    want |= {(92, 0)}
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.leaks(rows, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    whole = next(r for r in got if r["doc_id"] == 92)
    assert whole["score"] == 1 and (whole["start_word"], whole["end_word"]) == (0, 40)
    clean = dc.clean(rows, bench)
    assert clean.columns == rows.columns and {r["doc_id"] for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert dc.leaks(rows, bench.limit(0)).count() == dc.leaks(rows.limit(0), bench).count() == 0


def test_item_that_is_everywhere(spark):
    rng = random.Random(3)
    item = " ".join(_words(rng, 30))
    docs = spark.createDataFrame([(i, " ".join(_words(rng, 30)) + " " + item) for i in range(40)], "doc_id long, text string")
    assert dc.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 40


@pytest.mark.parametrize("n,copies", [(17, 1), (40, 1), (40, 30)])
def test_copy_edited_in_every_zone_beside_exact_ones(spark, monkeypatch, n, copies):
    """Also where all n-grams of the item are frequent."""
    monkeypatch.setattr(dc, "RARE", 8, raising=False)
    rng = random.Random(n)
    items = [_words(rng, n) for _ in range(4)]
    texts = []
    for item in items:
        texts += [_words(rng, 50) + item + _words(rng, 50) for _ in range(copies)]
        for first in (4, 6, 8, 9):
            edited = list(item)
            for at in range(first, n, dc.ZONE):
                edited[at] = f"x{at}"
            texts.append(_words(rng, 50) + edited + _words(rng, 50))
    number = {w: i for i, w in enumerate({w for t in [*items, *texts] for w in t})}
    coded = [[number[w] for w in t] for t in [*items, *texts]]
    items_, texts_ = coded[: len(items)], coded[len(items) :]
    want = {}
    for i, t in enumerate(texts_):
        for k, item in enumerate(items_):
            if 40 < i < len(texts) - 20 and i % 5:  # enough of the many copies
                continue
            score = _plain_align(item, t) / (dc.MATCH * n)
            if score >= dc.LEAST_SCORE:
                want[i, k] = score
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in dc.leaks(rows, bench).collect()}
    assert len(want) >= 20 or copies > 1
    assert {k: got.get(k) for k in want} == want and len(got) == len(texts)


def test_passages(spark):
    rng = random.Random(4)
    passage = " ".join(_words(rng, 60)) + "."
    near = passage.replace(passage.split()[30], "changed")
    docs = [(i, " ".join(_words(rng, 80)) + ".\n" + (passage if i % 4 == 0 else near if i % 4 == 2 else "") + "\n" + " ".join(_words(rng, 50)) + ".") for i in range(12)]
    docs += [(50, None), (51, ""), (52, docs[1][1]), (52, docs[1][1])]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = passages.repeated(rows).collect()
    lines = {r["doc_id"] for r in got if r["n_words"] == 60}
    assert lines == {i for i in range(12) if i % 2 == 0}
    assert {r["class_id"] for r in got if r["n_words"] == 60}.__len__() == 1
    assert {r["doc_id"] for r in got if r["n_words"] == 60 and not r["removed"]} == {0}
    assert {r["doc_id"] for r in got} == lines | {1, 52}  # a whole document stands twice
    left = {r["doc_id"]: r["text"] for r in passages.strip(rows).collect()}
    assert passage in left[0] and passage not in left[4] and near not in left[2] and left[50] is None and left[52] == ""
    assert passages.repeated(rows.limit(0)).count() == 0


def test_passages_of_any_form(spark):
    """Pasted in mid-sentence, wrapped anew, and in lines of four words: each is found, and only where it stands."""
    rng = random.Random(6)
    lines = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    sentences = lambda w: [x + "." if i in (17, 34) else x for i, x in enumerate(w)]
    docs, at, kinds = [], {}, {}
    for k in range(40):
        words = _words(rng, passages.PASSAGE, 10**6)
        for copy in range(2):
            before, after = _words(rng, 20 + rng.randrange(30), 10**6), _words(rng, 20 + rng.randrange(30), 10**6)
            w = sentences(words) if k % 4 == 1 else words
            body = lines(w, 4) if k % 4 == 2 else lines(w, 7 + 6 * copy) if k % 4 == 3 else " ".join(w)
            ends = "\n" if k % 4 == 2 else " "
            i = len(docs)
            docs.append((i, " ".join(before) + ends + body + ends + " ".join(after)))
            at[i], kinds[i] = (len(before), len(before) + passages.PASSAGE), k
    got = passages.repeated(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    covered = {}
    for r in got:
        a, z = r["start_word"], r["start_word"] + r["n_words"]
        assert at[r["doc_id"]][0] <= a and z <= at[r["doc_id"]][1]
        assert r["first_doc_id"] == 2 * kinds[r["doc_id"]] and r["removed"] == bool(r["doc_id"] % 2)
        covered.setdefault(r["doc_id"], set()).update(range(a, z))
    assert covered.keys() == at.keys() and min(map(len, covered.values())) >= passages.RUN


def test_passages_are_tuned():
    n, rows = passages.tune()
    assert 1 - (1 - passages.SIMILAR**rows) ** n >= passages.RECALL


def _corpus(rng, n):
    follows = {w: [f"t{rng.randrange(80)}" for _ in range(3)] for w in [f"t{i}" for i in range(80)]}
    out = []
    for i in range(n):
        w, text = f"t{rng.randrange(80)}", []
        for _ in range(60):
            text.append(w)
            w = rng.choice(follows[w])
        out.append((i, " ".join(text)))
    return out


def test_language_model(spark):
    docs = [*_corpus(random.Random(5), 120), (500, None), (501, ""), (502, "Never SEEN \x0b words"), (503, "t1 t2"), (503, "t1 t2"), (None, "t1")]
    got = py.score(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    split = lambda t: [w.lower() for w in (t or "").replace("\x0b", " ").split(" ") if w]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = {}
    for i, t in docs:
        if not held(i):
            for w in [*split(t), None]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i), len(split(t)) + 1, sum(w in counts for w in [*split(t), None]), n, round(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*split(t), None]), 6)) for i, t in docs)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    far = [r for r in got if r["held_out"] and r["n_tokens"] > 50]
    assert far and sum(r["score"] for r in far) > 0.7 * sum(r["base_score"] for r in far)  # contexts tell more than counts
    assert py.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = "<html><head><title>T</title><style>x</style></head><body><header>Site</header><nav><a href='/'>Home</a></nav><div class='cookie'>We use cookies</div><article><h1>Head {i}</h1><p>First &amp; <b>bold</b>   text {i}.</p><script>var x = '<p>no</p>';</script><p>Second {i}<br>line.</p></article><aside>Ad</aside><div id='comments'>Nice</div><footer>Foot</footer></body></html>"


def test_pages(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.replace("{i}", str(i))) for i in range(8)] + [(50, None, None), (51, "nonsense", ""), (52, "https://one.example/", PAGE.replace("{i}", "z")), (52, "https://one.example/", PAGE.replace("{i}", "z"))]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i]["text"] == f"Head {i}\n\nFirst & bold text {i}.\n\nSecond {i} line."
    assert (got[50]["text"], got[50]["n_chars"], got[51]["text"]) == ("", 0, "")
    assert got[52]["text"].startswith("Head z") and got[52]["n_chars"] == len(got[52]["text"])
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = table(spark, SF, "documents")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
        docs = kept
    out = cp.run(spark, SF)
    assert out.count() == docs.count() and {"n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.where(F.col("text").isNotNull() & (F.col("n_chars") != F.char_length("text"))).isEmpty()


@pytest.mark.parametrize("name", ["doc_id", "text"])
def test_documents_keep_clashing_columns(spark, name):
    docs = table(spark, SF, "documents").where("doc_id < 60")
    rows = docs.withColumns({c: F.lit("mine") for c in ("key", "root", "node", "n", "toxic", "junk", "ids", "hn", "h", "bands", "item_id", "quality", "class_id")})
    for made in (dc.clean(rows, table(spark, SF, "benchmark")), nd.keep_one(rows), quality_model.classify(rows, table(spark, SF, "labels")), bpe.with_digests(rows, leaf=2000)):
        kept = made.select(name, "key", "root", "n", "toxic", "ids").collect()
        assert kept and all(r[1:] == ("mine",) * 5 for r in kept)
    assert nd.classes(rows).where("key <> 'mine' or root <> 'mine'").isEmpty()
