"""Codes against Lloyd's rounds in plain Python, and against the SQL."""

import hashlib
import math
import random

import pytest

from skeinflow.llm import queries, vector_codes
from skeinflow.llm.vectors import dots, limit

from ..oracle import connect, same

KIND = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds, scale):
    """{vec_id: (code, error, label_error, digest)} with every sum made anew from all rows."""
    fine = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine = sorted(fine, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[[math.floor(scale * x) for x in v[k * len(v) // parts : (k + 1) * len(v) // parts]] for k in range(parts)] for _, v, _ in fine]
    book = [[c[k] for c in cut[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(book[k])), key=lambda j: (far(c[k], book[k][j]), j)) for k in range(parts)] for c in cut]  # noqa: E731,B023
    for _ in range(rounds):
        at = assign()
        for k in range(parts):
            for j in range(len(book[k])):
                own = [c[k] for c, a in zip(cut, at, strict=True) if a[k] == j]
                if own:
                    book[k][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in book for e in b for x in e).encode()).hexdigest()
    at = assign()
    errors = [sum(far(c[k], book[k][a[k]]) for k in range(parts)) for c, a in zip(cut, at, strict=True)]
    by = {}
    for (_, _, label), e in zip(fine, errors, strict=True):
        by[label] = by.get(label, 0) + e
    return sorted((str((i, "".join(f"{j:02x}" for j in a), e, by[label], digest)) for (i, _, label), a, e in zip(fine, at, errors, strict=True)))


def told(df):
    return sorted(str((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"])) for r in df.collect())


@pytest.mark.parametrize("parts, entries, rounds", [(4, 5, 2), (2, 8, 4), (4, 64, 1)])
def test_against_plain(spark, parts, entries, rounds):
    rng = random.Random(parts * entries)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [float(round(x + rng.gauss(0, 0.1), 3)) for x in rng.choice(some)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [1.0] * 7 + [None], 1), (202, [float("nan")] * 8, 2), (203, [float("inf")] * 8, 2), (204, rows[0][1], 1), (204, rows[0][1], 1), (None, rows[1][1], None)]
    df = spark.createDataFrame(rows, KIND.replace("float", "double")).repartition(5)
    assert told(vector_codes.encode(df, parts, entries, rounds)) == plain(rows, parts, entries, rounds, 256)


def test_large_components(spark):
    """Components beyond what floats hold exactly, sums and errors by whole numbers."""
    rows = [(i, [float(x * 2**18 + i) for x in (1, -1, 1, 1)], 1) for i in range(7)]
    df = spark.createDataFrame(rows, KIND.replace("float", "double"))
    assert told(vector_codes.encode(df, 2, 3, 2)) == plain(rows, 2, 3, 2, 256)
    huge = spark.createDataFrame([(1, [3e38, -3e38], 1), (2, [0.0, 1.0], 1)], KIND)
    most = limit(8)
    a, b = most // 2, (256 - most) // 2
    got = [r["error"] for r in vector_codes.encode(huge, 2, 1, 1).orderBy("vec_id").collect()]
    assert got == [(most - a) ** 2 + (-most - b) ** 2, a**2 + (256 - b) ** 2] and most > 2**29


def test_odd_rows(spark):
    none = spark.createDataFrame([], KIND)
    assert vector_codes.encode(none).count() == 0
    assert vector_codes.encode(spark.createDataFrame([(1, None, 1)], KIND)).count() == 0
    uneven = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1), (2, [1.0], 1), (3, [], None)], KIND)
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.encode(uneven, 2, 3, 1).collect()}
    assert got == {1: ("0000", 0, 0), 2: ("0101", 0, 0), 3: ("0201", 0, 0)}  # its second part is that of the second vector
    clash = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", b"y")], KIND + ", code string, was binary")
    assert vector_codes.encode(clash, 2, 3, 1).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_exact_products():
    import numpy as np

    big = limit(4)
    a = np.array([[big, big, -big, 1.0]])
    assert dots(a, a).tolist() == [[3 * big * big + 1]]


def test_sql(spark, sf_dir):
    same(queries.queries()["op13_delta_codes"](spark, sf_dir), connect(sf_dir), vector_codes.SQL)
