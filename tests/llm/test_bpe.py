"""Encoding against the library, joins of parts against the whole."""

import hashlib
import random

import pytest
from hypothesis import given, settings as hyp, strategies as st

from skeinflow.llm import bpe

CODEC = None


def codec():
    global CODEC
    CODEC = CODEC or bpe.Codec(bpe.default_path())
    return CODEC


SIGNS = ["hello", "World's", " ", "  ", "\n", "é", "é", "Straße", "don't", "12345", "漢字", "😀", "a" * 40, "!!!", "<|endoftext|>", "<|startoftext|>", "İ", "ﬁ", " ", "\t", "_x_", "'LL", "한국"]


@hyp(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=40), st.lists(st.sampled_from(SIGNS), max_size=40))
def test_join(a, b):
    left, right = "".join(a), "".join(b)
    at = bpe.cuts(left + right, codec(), max(1, len(left)))
    parts = [codec().part((left + right)[i:j]) for i, j in zip(at, at[1:], strict=False)]
    assert bpe.tree(parts, codec()).ids.tolist() == codec().ids(left + right)


@hyp(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), max_size=60))
def test_digests(words):
    text = "".join(words)
    ids = codec().ids(text)
    decoded = codec().tok.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert codec().digests(text) == (len(ids), sha(" ".join(map(str, ids))), sha(decoded))


@pytest.mark.parametrize("leaf", [5, 64, 32_768])
def test_frames(spark, leaf):
    rng = random.Random(leaf)
    texts = [None, "", " ", "Hello hello", "Hello hello", "a" * 3000] + ["".join(rng.choices(SIGNS, k=rng.randrange(200))) for _ in range(20)]
    rows = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(rows, leaf=leaf).collect()}
    assert got == {i: codec().ids(t or "") for i, t in enumerate(texts)}
    told = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.with_digests(rows, leaf=leaf).collect()}
    assert told == {i: codec().digests(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["decoded"] for r in bpe.decode(bpe.encode(rows, leaf=leaf)).collect()}
    assert back == {i: codec().tok.decode(codec().ids(t or ""), skip_special_tokens=False) for i, t in enumerate(texts)}


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.with_digests(rows).count() == 0 and bpe.encode(rows).columns == ["doc_id", "text", "ids"]
