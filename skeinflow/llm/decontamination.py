"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters and digits, A-Z lowered. Every n-gram of an item that at most RARE corpus texts
hold is a seed, so that copies with different edits each have the seeds that their edits left. Every item is
cut into zones of ZONE n-grams; of a zone of frequent n-grams those are seeds that at most COMMON times as many
texts hold as its median one, so that also an item that is everywhere has seeds in all places. Passages of
the texts around seeds are aligned with the item; the score is the local alignment's share of the item's full score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Bits, brief, checkpoint, grams, passes, signed

SEED, ZONE = 4, 8
#: Texts that may hold a seed, and how many times as many as its zone's median n-gram if that is more.
RARE, COMMON = 1_000, 2
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's full score from which a text counts as holding the item.
LEAST_SCORE = 0.4
#: Words beside an item's length by which a passage may be longer.
SLACK = 16


def item_grams(benchmark: DataFrame) -> DataFrame:
    """Rows (item_id, at, h) of the n-grams of the items, and `words`, the items' word hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in passes(b.column("text"), alnum=True):
                hashes = words.hashes(lower=True)
                h, doc, at = grams(words, hashes, SEED, short=False)
                ids = b.column("item_id").slice(lo, hi - lo)
                per = np.searchsorted(doc, np.arange(hi - lo + 1))
                first = words.first_word
                for i in range(hi - lo):
                    own = slice(per[i], per[i + 1])
                    if per[i] < per[i + 1]:
                        yield pa.RecordBatch.from_arrays([ids.slice(i, 1), pa.array([signed(hashes[first[i] : first[i + 1]]).tobytes()], pa.binary()), pa.array([(at[own] - first[i]).astype(np.int32)], pa.list_(pa.int32())), pa.array([signed(h[own])], pa.list_(pa.int64()))], ["item_id", "words", "at", "h"])

    return benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(run, "item_id long, words binary, at array<int>, h array<long>")


def _counts(docs: DataFrame, bits: Bits) -> DataFrame:
    """Rows (h, df): in how many texts each n-gram that may be an item's stands."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.words)  # 1 MB, whatever the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bits(shared.value)
        for b in batches:
            found = []
            for _, _, words in passes(b.column("text"), alnum=True):
                h, doc, _ = grams(words, words.hashes(lower=True), SEED, short=False)
                on = may(h)
                pair = np.unique(np.stack([doc[on].astype(np.uint64), h[on]], axis=1), axis=0) if on.any() else np.zeros((0, 2), np.uint64)
                found.append(pair[:, 1])
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "n"])

    return docs.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("df"))


def _passages(docs: DataFrame, bits: Bits, reach: int) -> DataFrame:
    """Rows (key, no, start, words, at, h): passages of texts, no seeds of which are further apart than
    `reach` words, with the hashes of their words and so many around, and the seeds' places."""
    shared = docs.sparkSession.sparkContext.broadcast(bits.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bits(shared.value)
        for b in batches:
            rows: list[tuple] = []
            for lo, _, words in passes(b.column("text"), alnum=True):
                hashes = words.hashes(lower=True)
                h, doc, at = grams(words, hashes, SEED, short=False)
                on = np.flatnonzero(may(h))
                if not len(on):
                    continue
                h, doc, at = h[on], doc[on], at[on]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > reach)
                edges = np.append(np.flatnonzero(new), len(at))
                for no, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    first, end = words.first_word[doc[i]], words.first_word[doc[i] + 1]
                    a, z = max(first, at[i] - reach), min(end, at[j - 1] + SEED + reach)
                    rows.append((b.column("key")[lo + int(doc[i])].as_py(), no, int(a - first), signed(hashes[a:z]).tobytes(), (at[i:j] - a).astype(np.int32), signed(h[i:j])))
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.int64()))], ["key", "no", "start", "words", "at", "h"])

    return docs.select("key", "text").mapInArrow(run, "key binary, no int, start int, words binary, at array<int>, h array<long>")


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and the words [start, end) of the text that it covers."""
    n = len(text)
    if not n or not len(item):
        return 0, 0, 0
    steps = np.arange(n + 1) * GAP
    above, above_from = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
    best, span = 0, (0, 0)
    for w in item:
        diagonal = above[:-1] + np.where(text == w, MATCH, MISMATCH)
        down = above[1:] + GAP
        here, come = np.zeros(n + 1, dtype=np.int64), np.arange(n + 1)
        take = diagonal >= down
        here[1:] = np.where(take, diagonal, down)
        come[1:] = np.where(take, above_from[:-1], above_from[1:])
        fresh = here <= 0
        here[fresh] = 0
        come[fresh] = np.flatnonzero(fresh)
        lifted = here - steps  # a gap in the item costs GAP a word: a running maximum
        top = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        here, come = top + steps, come[src]
        if here.max() > best:
            end = int(here.argmax())
            best, span = int(here[end]), (int(come[end]), end)
        above, above_from = here, come
    return best, *span


_FOUND = "key binary, item_id long, score double, start int, end int"


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            item, text = np.frombuffer(r.item, dtype=np.int64), np.frombuffer(r.words, dtype=np.int64)
            a, z = max(0, r.low - SLACK - len(item) // 4), min(len(text), r.high + len(item) + SLACK + len(item) // 4)
            if MATCH * np.isin(text[a:z], item).sum() < LEAST_SCORE * MATCH * len(item):
                continue  # too few of the item's words for the score, in whatever order
            best, start, end = align(item, text[a:z])
            if best >= LEAST_SCORE * MATCH * len(item):
                out.append((r.key, r.item_id, best / (MATCH * len(item)), r.start + a + start, r.start + a + end))
        yield pd.DataFrame(out, columns=["key", "item_id", "score", "start", "end"])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (key, item_id, score, start, end), one for each text and item it holds: key is the MD5 of the text,
    score from LEAST_SCORE to 1, [start, end) the words of the best alignment. Texts are compared once,
    however often they stand in `docs(text)`. Null texts hold nothing; items under four words, which no
    seed can tell, and items of a null id are not searched. Items that are the same text are found alike."""
    texts = docs.where("text is not null").select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    items = checkpoint(item_grams(benchmark).dropDuplicates(["item_id", "words"]))
    longest = items.agg(F.max(F.octet_length("words") / 8)).first()[0]
    spark = docs.sparkSession
    if longest is None:
        return spark.createDataFrame([], _FOUND)
    each = items.select("item_id", "words", F.explode(F.arrays_zip("at", "h")).alias("g")).select("item_id", "words", "g.*")
    counts = _counts(texts, Bits.of(each.select("h").distinct(), "h"))
    zone = Window.partitionBy("item_id", "words", F.floor(F.col("at") / ZONE))
    most = F.greatest(F.lit(RARE), COMMON * F.median("df").over(zone))
    seeds = checkpoint(each.join(counts, "h").withColumn("most", most).where("df <= most").select("item_id", "words", "at", "h"))
    # Copies meet before passages are compared: a passage depends on its text alone.
    found = checkpoint(_passages(texts, Bits.of(seeds.select("h").distinct(), "h"), int(longest) + SLACK).dropDuplicates(["key", "no"]))
    hits = found.select("key", "no", F.explode(F.arrays_zip("at", "h")).alias("g")).select("key", "no", F.col("g.at").alias("there"), F.col("g.h").alias("h"))
    pairs = hits.join(seeds, "h").groupBy("key", "no", "item_id", F.col("words").alias("item")).agg(F.min(F.col("there") - F.col("at")).alias("low"), F.max(F.col("there") - F.col("at")).alias("high"))
    got = pairs.join(found.select("key", "no", "start", "words"), ["key", "no"]).select("key", "item_id", "item", "low", "high", "start", "words").mapInPandas(_aligned, _FOUND)
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), F.col("end").alias("end")))
    return got.groupBy("key", "item_id").agg(best.alias("b")).select("key", "item_id", "b.score", (-F.col("b.s")).alias("start"), "b.end")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.unhex(F.md5(F.col("text").cast("binary"))))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, score, start_word, end_word): each document with each item that it holds."""
    found = find(docs, benchmark)
    return _keyed(docs.select("doc_id", "text")).drop("text").join(found, F.col("_key") == F.col("key")).select("doc_id", "item_id", "score", F.col("start").alias("start_word"), F.col("end").alias("end_word"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the documents that hold an item; columns of any name stay as they are."""
    found = checkpoint(find(docs, benchmark).select("key").distinct())
    rows = _keyed(docs.select("text", F.struct(*docs.columns).alias("_row"))).drop("text")
    return rows.join(brief(found), F.col("_key") == F.col("key"), "left_anti").select("_row.*")
