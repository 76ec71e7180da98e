"""Near-duplicate documents: DartMinHash signatures, banded joins, exact checks, components.

DartMinHash throws darts at the plane of weight and rank. The plane over each element is cut into cells that
double in both directions; how many darts fall into a cell, where, and which coordinate each belongs to,
are hashes of the element and the cell. A document throws the darts below its elements' weights up to the
rank at which about k ln k + 2 k darts are expected, and of each coordinate keeps the dart of the lowest rank.
Two documents keep the same dart with the probability of their weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief, checkpoint, components, distinct, grams, mix, passes, release, signed, tidied, unit

SHINGLE, SIMILAR = 5, 0.8
#: Bands of rows: a pair of similarity 0.8 shares a band with probability 1 - (1 - 0.8**5)**20 = 0.9996.
BANDS, ROWS = 20, 5
#: Rank at which the first cell ends; later cells double.
FIRST_CELL = 0.25
#: Longs of a sketch's parity bits.
SKETCH = 16
_U = np.uint64


def _cells(top: float, first: float) -> list[tuple[float, float]]:
    out, low, high = [], 0.0, first
    while low < top:
        out.append((low, high))
        low, high = high, high * 2
    return out


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Poisson counts of a small or large mean by inversion of uniform numbers."""
    n = int(mean + 12 * mean**0.5 + 20)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    return np.searchsorted(np.cumsum(np.exp(np.arange(n + 1) * np.log(mean) - mean - logs)), u, side="right")


def darts(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, docs: int, k: int) -> np.ndarray:
    """Signatures (docs x k, uint64) of weighted sets: the elements (hashes), weights and set of each row.
    Empty sets have the signature 0."""
    out = np.zeros((docs, k), dtype=_U)
    total = np.bincount(doc, weights=weight, minlength=docs)
    want = np.full(docs, k * np.log(k) + 2.0 * k)
    open_ = np.flatnonzero(total > 0)
    while len(open_):
        rank = np.zeros(docs)
        rank[open_] = want[open_] / total[open_]
        take = rank[doc] > 0
        best_rank, best = _throw(doc[take], element[take], weight[take], rank, docs, k)
        full = np.isfinite(best_rank[open_]).all(axis=1)
        done = open_[full]
        out[done] = best[done]
        open_ = open_[~full]
        want[open_] *= 2
    return out


def _throw(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, rank: np.ndarray, docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    at, ranks, ids = [], [], []
    below, heavy, step = rank[doc], bool((weight >= 1.0).all()), _U(0xD1342543DE82EF95)
    top = float(rank.max(initial=0.0))
    for v, (w_low, w_high) in enumerate(_cells(float(weight.max(initial=0.0)), 1.0)):
        for r, (r_low, r_high) in enumerate(_cells(top, FIRST_CELL)):
            own = np.flatnonzero((weight > w_low) & (below > r_low))
            if not len(own):
                continue
            cell = mix(element[own] ^ _U(((v * 64 + r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            n = _poisson(unit(cell), (w_high - w_low) * (r_high - r_low))
            src = np.repeat(own, n)
            if not len(src):
                continue
            # A cell's darts are numbered from 1; here one count runs through all cells.
            dart = mix(np.repeat(cell - (np.cumsum(n) - n).astype(_U) * step, n) + np.arange(1, len(src) + 1, dtype=_U) * step)
            rk = r_low + unit(mix(dart + _U(1))) * (r_high - r_low)
            hit = rk < below[src]
            if w_high > 1.0 or not heavy:
                hit &= w_low + unit(mix(dart + _U(2))) * (w_high - w_low) < weight[src]
            src, rk, dart = src[hit], rk[hit], dart[hit]
            at.append(doc[src] * k + (mix(dart + _U(3)) % _U(k)).astype(np.int64))
            ranks.append(rk)
            ids.append(dart)
    best_rank, best = np.full(docs * k, np.inf), np.zeros(docs * k, dtype=_U)
    if at:
        place, rk, dart = np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)
        np.minimum.at(best_rank, place, rk)  # as sorting the darts would cost most of the signature
        lowest = rk == best_rank[place]
        place, dart = place[lowest], dart[lowest]
        best[place] = dart
        np.minimum.at(best, place, dart)  # of equal ranks the least dart
    return best_rank.reshape(docs, k), best.reshape(docs, k)


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """Hashes of the bands of signatures (docs x bands); the band's number is part of the hash."""
    docs, k = signature.shape
    out = np.zeros((docs, k // rows), dtype=_U)
    with np.errstate(over="ignore"):
        for b in range(k // rows):
            h = np.full(docs, _U(b + 1))
            for x in range(rows):
                h = mix(h * _U(0x9E3779B97F4A7C15) + signature[:, b * rows + x])
            out[:, b] = h
    return out


def sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray, docs: int) -> np.ndarray:
    """Parity sketches (docs x SKETCH longs) of sets of elements with their counts: bit b tells whether the elements
    that hash to b are odd in number. Two sets' sketches differ in no more bits than the sets do in elements."""
    size = 64 * SKETCH
    odd = np.bincount(doc * size + (h >> _U(7)).astype(np.int64) % size, weights=n, minlength=docs * size).astype(np.int64) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(docs, SKETCH)


def near(a: str, b: str, least: float) -> Column:
    """Whether two sketched sets can have the Jaccard similarity: sets of m and n elements that do differ in at most
    (1 - least) / (1 + least) (m + n) of them. It rules out, and never a pair that is similar."""
    apart = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(SKETCH))
    return F.expr(f"{apart} <= {(1 - least) / (1 + least)!r}D * ({a}.n + {b}.n) + 1e-6D")


def _signed_texts(n_bands: int, rows: int, counted: bool):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in passes(b.column("text")):
                h, doc, _ = grams(words, words.hashes(), SHINGLE)
                doc, h, n = distinct(doc, h)
                sig = bands(darts(doc, h, n.astype(float) if counted else np.ones(len(h)), hi - lo, n_bands * rows), rows)
                some = np.bincount(doc, minlength=hi - lo) > 0
                weight = n.astype(float) if counted else np.ones(len(h))
                size = np.bincount(doc, weights=weight, minlength=hi - lo).astype(np.int64)
                bits = sketches(doc, h, weight, hi - lo)
                each = lambda k, x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * k)]).astype(np.int32)), pa.array(x[some].reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), each(n_bands, signed(sig)), pa.array(size), each(SKETCH, bits)], ["key", "bands", "n", "bits"])

    return run


def jaccard(a: str | None, b: str | None, counted: bool = False) -> float:
    """Jaccard similarity of two texts' sets of word shingles; counted: of their multisets."""
    h, doc, _ = next(((*grams(w, w.hashes(), SHINGLE),) for _, _, w in [_joined(a or "", b or "")]))
    doc, h, n = distinct(doc, h)
    x, y = dict(zip(h[doc == 0].tolist(), n[doc == 0].tolist(), strict=True)), dict(zip(h[doc == 1].tolist(), n[doc == 1].tolist(), strict=True))
    if not counted:
        x, y = dict.fromkeys(x, 1), dict.fromkeys(y, 1)
    both = sum(min(c, y[e]) for e, c in x.items() if e in y)
    of = sum(x.values()) + sum(y.values()) - both
    return both / of if of else 0.0


def _joined(a: str, b: str):
    from .common import Words

    x, y = a.encode("utf-8", "surrogatepass"), b.encode("utf-8", "surrogatepass")
    return 0, 2, Words(np.frombuffer(x + y, dtype=np.uint8), np.array([0, len(x), len(x) + len(y)], dtype=np.int64))


def _checked(least: float, counted: bool):
    @F.pandas_udf("boolean")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, counted) >= least for x, y in zip(a, b, strict=True)], dtype=bool)

    return run


def _verified(pairs: DataFrame, texts: DataFrame, check) -> DataFrame:
    """The pairs (a, b) of keys whose texts pass the check."""
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return both.where(check("ta", "tb")).select("a", "b")


def _sketched(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose sketches can be similar."""
    of = lambda side: marks.select(F.col("key").alias(side), F.struct("n", "bits").alias(f"m{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(near("ma", "mb", least)).select("a", "b")


def linked(buckets: DataFrame, marks: DataFrame, texts: DataFrame, check, least: float, star_rounds: int = 2, ready: bool = False) -> DataFrame:
    """Rows (node, root) of the components of similar texts: of `buckets(bucket, key)`, the keys that share a
    bucket are compared by their sketches, `marks(key, n, bits)`, and where these can be similar to the degree `least`,
    by `check` on their `texts(key, text)`.

    First each bucket's keys are compared with one of them, whose choice differs by round, so that a bucket
    of many copies costs one comparison for each. Then, in buckets that still hold several components, each
    key outside the bucket's largest component meets the keys of the other components. A pair within a component needs
    no comparison, and a join gives only pairs whose sketches can be similar, so that a group of texts that are
    all somewhat alike gives few; no other pair of a bucket is left out.
    ready: marks and texts are written already and hold each key once."""
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = checkpoint(buckets.join(shared, "bucket").select("bucket", "key"))
    need = checkpoint(shared.select("key").distinct())
    own_texts = texts
    if not ready:
        few = brief(need)  # then the texts that meet no other aren't shuffled
        marks = checkpoint(marks.join(few, "key", "left_semi").select("key", "n", "bits").dropDuplicates(["key"]))
        own_texts = checkpoint(texts.join(few, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text")))
    release(need.sparkSession)
    tested, edges, roots = None, None, None
    for turn in range(star_rounds + 1):
        if roots is None:
            mixed = shared.withColumn("root", F.col("key"))
        else:
            now = shared.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
            several = now.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
            mixed = checkpoint(now.join(several, "bucket"))
            if mixed.isEmpty():
                break
        size = mixed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("key", F.lit(turn)).alias("h"), "key")).alias("k"))
        lead = size.groupBy("bucket").agg(F.max(F.struct("n", F.col("k.h").alias("h"), F.col("root").alias("r"), F.col("k.key").alias("lead"))).alias("m")).select("bucket", "m.r", "m.lead")
        outside = mixed.join(lead, "bucket").where("root <> r")
        if turn < star_rounds:
            pairs = outside.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).where("a <> b").distinct()
            pairs = _sketched(pairs, marks, least)
        else:
            # A key has as many buckets as bands at most; a pair meets in the least bucket that it shares.
            known = checkpoint(marks.join(mixed.groupBy("key").agg(F.collect_set("bucket").alias("in")), "key"))
            own = F.struct("n", "bits", "in")
            x = outside.join(known, "key").select("bucket", F.col("key").alias("k1"), F.col("root").alias("r1"), own.alias("m1"))
            y = mixed.join(known, "key").select(F.col("bucket").alias("b2"), F.col("key").alias("k2"), F.col("root").alias("r2"), own.alias("m2"))
            met = x.join(y, (F.col("bucket") == F.col("b2")) & (F.col("r1") != F.col("r2")) & near("m1", "m2", least) & F.expr("array_min(array_intersect(m1.in, m2.in)) = bucket"))
            pairs = met.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = checkpoint(pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        new = checkpoint(_verified(pairs, own_texts, check))
        release(new.sparkSession)
        if new.isEmpty():
            continue
        # Earlier components count as stars around their roots.
        edges = new if roots is None else new.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
        roots = components(edges)
    if roots is None:
        return need.limit(0).select(F.col("key").alias("node"), F.col("key").alias("root"))
    return roots


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))


def groups(docs: DataFrame, n_bands: int = BANDS, rows: int = ROWS, least: float = SIMILAR, counted: bool = False) -> DataFrame:
    """Rows (node, root) for `docs(text)`: node the MD5 of a text that is similar to another text, root that of
    its group. Texts without words are similar to none. counted: weigh shingles by how often they stand in
    the text (weighted Jaccard), else each counts once, as does the check."""
    texts = _keyed(docs.select("text")).select(F.col("_key").alias("key"), "text")
    marks = checkpoint(texts.mapInArrow(_signed_texts(n_bands, rows, counted), "key binary, bands array<long>, n long, bits array<long>"))
    buckets = marks.select("key", F.explode("bands").alias("bucket")).distinct()
    return linked(buckets, marks, texts, _checked(least, counted), least)


def classes(docs: DataFrame, keep: list[str] | None = None, **how) -> DataFrame:
    """`docs` (doc_id, text, ...; columns of any name stay, these two are replaced) with class_id, the least doc_id of the document's group of near and exact
    copies, and n_in_class, the documents of the group. A document without words is a group of its own, as is
    one of a null doc_id without other copies, whose class_id is null.

    keep: the columns of `docs` to return, by default all. Name those needed where the texts aren't, as rows are shuffled."""
    docs = docs.drop("class_id", "n_in_class")
    keep = docs.columns if keep is None else keep
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = _keyed(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"))).select("doc_id", "_key", "_row", word.alias("_word"))
    found = checkpoint(groups(docs, **how))
    rows = rows.join(brief(found).withColumnRenamed("node", "_key"), "_key", "left").withColumn("_class", F.when(F.col("_word"), F.coalesce("root", "_key")))
    # One row for each class of several documents: copies meet before the shuffle, and the few rows are broadcast.
    size = rows.where("_class is not null").groupBy(F.col("_class").alias("_c")).agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    out = rows.join(brief(checkpoint(size)), F.col("_class") == F.col("_c"), "left")
    return out.select("_row.*", F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_least")).alias("class_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("n_in_class"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """`docs` with one document of each group: the first by doc_id, then by text and the other columns.
    Documents without words all stay. Of rows of a group that agree in all columns one stays."""
    found = checkpoint(groups(docs, **how))
    word = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", (F.xxhash64(*other) if other else F.lit(0).cast("long")).alias("_other"), F.struct(*docs.columns).alias("_row"))
    rows = _keyed(packed).withColumn("_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Who goes is settled without the texts.
    slim = rows.where(word).select("_key", "_id", "_other", "doc_id").join(found.withColumnRenamed("node", "_key"), "_key", "left")
    slim = slim.select("_key", "_id", "_other", F.coalesce("root", "_key").alias("_class"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key", "_other").alias("_rank"))
    best = checkpoint(slim.groupBy("_class").agg(F.min("_rank").alias("_best"), F.count("*").alias("n")).where("n > 1").drop("n"))
    ranked = slim.join(brief(best), "_class")
    go = checkpoint(ranked.groupBy("_key", "_id", "_other").agg(F.count("*").alias("n"), F.first(F.col("_rank") == F.col("_best")).alias("first")).where("n > 1 or not first"))
    stay = rows.join(brief(go.select("_key", "_id", "_other")), ["_key", "_id", "_other"], "left_anti")
    twice = go.where("first").select("_key", "_id", "_other")
    if twice.isEmpty():
        return stay.select("_row.*")
    one = rows.join(brief(checkpoint(twice)), ["_key", "_id", "_other"], "left_semi").dropDuplicates(["_key", "_id", "_other"])
    return stay.select("_row.*").unionByName(one.select("_row.*"))
