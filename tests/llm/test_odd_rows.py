"""Every operator and stage with nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from skeinflow.llm import bpe, decontamination, near_duplicates, passages, pii, quality_model, quality_rules, sharding
from skeinflow.llm.common import table

from ..conftest import SF

NAMES = "key root node n toxic junk ids h bands bits item_id _row _key _id _w _n _k _part _base _pii _spans _class stratum slot_ host at".split()
LABELS, ITEMS = "doc_id long, quality int, toxic int", "item_id long, text string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(7)
    say = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    long, text = say(120_000), say(60)
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (4, text), (4, text), (5, text), (None, text), (None, None), (6, long), (7, long), (8, "x" * 300_000), (9, "a\n" * 50_000), (10, "jane@example.com " * 20_000), (11, text.replace(" ", "\n", 3))]
    rows = [(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("mine") for c in NAMES}).repartition(3).cache()


def _rows(df):
    return sorted(map(str, df.collect()))


def _stages(spark, labels, items):
    return {
        "quality": lambda d: quality_model.keep_good(d, labels),
        "classes": lambda d: near_duplicates.classes(d).select(*d.columns),
        "weighted": lambda d: near_duplicates.classes(d, counted=True).select(*d.columns),
        "rules": lambda d: quality_rules.apply_rules(d, labels).select(*[c for c in d.columns if c != "text"]),
        "clean": lambda d: decontamination.clean(d, items),
        "digests": lambda d: bpe.with_digests(d).select(*d.columns),
        "shards": lambda d: sharding.slots(sharding.assign(d, sharding.layout(8)), [F.col("doc_id"), F.col("text")]).select(*d.columns),
    }


STAGES = ["quality", "classes", "weighted", "rules", "clean", "digests", "shards"]


@pytest.mark.parametrize("name", STAGES)
def test_rows_pass_unchanged(spark, odd, name):
    """Without labels and items nothing goes, and every column is as it was."""
    stage = _stages(spark, spark.createDataFrame([], LABELS), spark.createDataFrame([], ITEMS))[name]
    want = odd.drop("text") if name == "rules" else odd
    assert _rows(stage(odd)) == _rows(want)
    assert stage(odd.limit(0)).count() == 0 and stage(odd.limit(0)).columns == want.columns


def test_near_copies(odd):
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 6, 8, 9, 10]
    found = {(r["doc_id"], r["class_id"], r["n_in_class"]) for r in near_duplicates.classes(odd).collect()}
    assert {(4, 4, 5), (5, 4, 5), (None, 4, 5), (11, 4, 5), (6, 6, 2), (7, 6, 2), (1, 1, 1), (None, None, 1)} <= found


def test_items_and_passages(spark, odd):
    text = odd.where("doc_id = 4").first()["text"]
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text), (3, ""), (4, text)], ITEMS)
    gone = {r["doc_id"] for r in odd.collect()} - {r["doc_id"] for r in decontamination.clean(odd, items).collect()}
    assert gone == {4, 5, 11}  # the null id stays for its row without text
    found = passages.repeated(odd)
    assert {r["doc_id"] for r in found.select("doc_id").distinct().collect()} == {4, 5, 6, 7, 11, None}
    left = passages.strip(odd, found)
    assert left.columns == odd.columns and left.count() == odd.count() and left.where("_spans <> 'mine'").isEmpty()
    assert passages.repeated(odd.limit(0)).count() == passages.strip(odd.limit(0)).count() == 0


def test_pseudonyms(odd):
    got = pii.pseudonymise(odd, "key")
    assert got.drop("pii_counts").columns == odd.columns and {r["doc_id"] for r in got.where("size(pii_counts) > 0").collect()} == {10}
    assert _rows(got.where("doc_id <> 10").drop("pii_counts")) == _rows(odd.where("doc_id <> 10"))


def test_stages(spark, odd):
    import corpus_pipeline as cp

    docs = odd
    for name, stage in cp.STAGES:
        assert set(docs.columns) <= set(stage(spark, docs.limit(0), SF).columns)
        docs = stage(spark, docs, SF)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == odd.columns, name
        docs = docs.cache()
        assert docs.where("_key <> 'mine' or host <> 'mine'").isEmpty(), name
    assert docs.count() and table(spark, SF, "documents").columns == odd.columns[:5]
