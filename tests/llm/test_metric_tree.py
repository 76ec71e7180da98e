"""Search in the tree against all products, and against the SQL."""

import math
import random

import pytest

from skeinflow.llm import metric_tree, queries

from ..oracle import connect, same

KIND = "vec_id long, embedding array<double>"


def plain(rows, k, every, scale=1024):
    """Rows by comparing every query with every row."""
    fine = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(fine):
        if i is None or i % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j is None, j or 0) for m, (j, v) in enumerate(fine) if m != n)
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(scores[:k], 1)]
    return sorted(map(str, out))


def told(df):
    return sorted(str((r["query_id"], r["rank"], r["vec_id"], r["score"])) for r in df.collect())


@pytest.mark.parametrize("spread, page, per_route", [(0.05, 8, 40), (1.0, 16, 100), (0.3, 256, 10**6)])
def test_against_all(spark, spread, page, per_route):
    rng = random.Random(page)
    some = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(9)]
    rows = [(i, [x * rng.choice((0.5, 1, 3)) + rng.gauss(0, spread) for x in rng.choice(some)]) for i in range(600)]
    rows += [(1000 + i, some[0]) for i in range(300)]  # a third of all are copies
    rows += [(2000, None), (2001, [1.0] * 11 + [None]), (2100, [float("nan")] * 12), (2003, [float("-inf")] * 12), (300, rows[300][1]), (None, some[1]), (2200, [1.0, -2.0]), (2300, [])]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    assert told(metric_tree.search(df, 7, 20, page=page, per_route=per_route)) == plain(rows, 7, 20)


def test_few_and_none(spark):
    assert metric_tree.search(spark.createDataFrame([], KIND)).count() == 0
    assert metric_tree.search(spark.createDataFrame([(0, None)], KIND)).count() == 0
    rows = [(0, [1.0, 2.0]), (100, [2.0, 1.0]), (7, [-1.0, 0.5])]
    assert told(metric_tree.search(spark.createDataFrame(rows, KIND))) == plain(rows, 10, 100)
    assert metric_tree.search(spark.createDataFrame([(0, [1.0])], KIND)).count() == 0
    wide = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], KIND + ", query string, row int")
    assert told(metric_tree.search(wide)) == plain(rows, 10, 100)


def test_large_components(spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(-(2**19), 2**19)) for _ in range(4)]) for i in range(200)]
    assert told(metric_tree.search(spark.createDataFrame(rows, KIND), 5, 10, page=16, per_route=50)) == plain(rows, 5, 10)
    huge = spark.createDataFrame([(0, [3e38, 3e38]), (1, [3e38, -3e38]), (2, [3e38, 3e38])], KIND)
    assert [r["vec_id"] for r in metric_tree.search(huge).orderBy("rank").collect()] == [2, 1]


def test_bounds_spare_pages(spark):
    """In groups that lie apart most routes and pages are ruled out."""
    rng = random.Random(4)
    some = [[rng.gauss(0, 5) for _ in range(16)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.01) for x in some[i % 20]]) for i in range(2000)]
    df = spark.createDataFrame(rows, KIND)
    tree = metric_tree.Search(df, 1024, "vec_id", "embedding", 64, 50, 32)
    asked = tree.queries(100).selectExpr("*", f"{metric_tree._NONE} as best")
    first = metric_tree._top(tree.found(tree.visits(asked, 10, True), 10), 10).groupBy("query").agg({"score": "min"}).withColumnRenamed("min(score)", "best")
    more = tree.visits(asked.drop("best").join(first, "query"), 10, False)
    assert more.count() < 0.5 * asked.count() * len(tree.routes.rows)
    assert told(metric_tree.search(df, per_route=50, page=32, routes=64)) == plain(rows, 10, 100)


def test_sql(spark, sf_dir):
    same(queries.queries()["op11_metric_tree"](spark, sf_dir), connect(sf_dir), metric_tree.SQL)
