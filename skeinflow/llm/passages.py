"""Repeated passages: paragraph MinHash banding, exact checks, and clusters of removals.

Paragraphs are all lines that have a shingle, compared by MinHash bands and exact Jaccard similarity, and, so
that a passage pasted into other text is found as well, the sentences inside lines, which are paragraphs of
their own that only their equals match.
Passages that keep to no lines and sentences are found by stretches of the whole text that start where its
content says (winnowing): two texts that share PASSAGE words share a stretch of RUN of them at least.
A document's repeated paragraphs that lie next to one another make a passage; passages of RUN words or more
count. Of a class of equal or similar paragraphs one document's stay, all others go."""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Bits, Words, _power, brief, checkpoint, distinct, free, grams, mix, passes, release, signed, tidied
from .near_duplicates import SHINGLE, SIMILAR, SKETCH, _checked, bands, darts, linked, sketches

#: Words of a line that is compared by MinHash, the fewest that make a shingle: a word put before or behind a line of eight
#: leaves it at 0.8. Words of a sentence; of a passage; between paragraphs of one passage.
LINE, SENTENCE, RUN, GAP = SHINGLE, 5, 20, 8
#: Words of a passage that is found wherever it starts and ends.
PASSAGE = 51
#: A stretch without a sentence's end is cut by its content from so many words on, and at the latest after so many.
UNSPLIT, LONGEST = 40, 64
RECALL = 0.99
_U = np.uint64


def tune(similar: float = SIMILAR, recall: float = RECALL, most: int = 200) -> tuple[int, int]:
    """Bands and rows: of those within `most` values and a false share of 25 % at half the similarity, the
    fewest values that find a pair of the similarity with the recall."""
    found = []
    for rows in range(1, 13):
        for n in range(1, most // rows + 1):
            if 1 - (1 - similar**rows) ** n >= recall:
                if 1 - (1 - (similar / 2) ** rows) ** n <= 0.25:
                    found.append((rows * n, n, rows))
                break
    _, n, rows = min(found)
    return n, rows


def _starts(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words start a line, and which a sentence."""
    n = len(h)
    line, sentence = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if not n:
        return line, sentence
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    line[0] = True
    line[1:] = (breaks[words.starts[1:]] > breaks[words.ends[:-1]]) | (words.doc[1:] != words.doc[:-1])
    sentence[:] = line
    sentence[1:] |= np.isin(words.data[words.ends[:-1] - 1], np.frombuffer(b".!?", dtype=np.uint8))
    edges = np.append(np.flatnonzero(sentence), n)
    long = np.flatnonzero(np.diff(edges) > UNSPLIT)
    sentence[_content_cuts(h, edges[long], edges[long + 1])] = True
    return line, sentence


def _content_cuts(h: np.ndarray, a: np.ndarray, z: np.ndarray, reach: int = 4) -> np.ndarray:
    """Of stretches of words [a, z) that don't overlap, in their order: their first words, the words whose run of three is
    the strict minimum among its neighbours in the stretch, and where these are further apart every LONGEST words."""
    at, of = _ranges(a, z - 2), np.repeat(np.arange(len(a)), z - 2 - a)
    with np.errstate(over="ignore"):
        g = mix(h[at] + h[at + 1] * _U(3) + h[at + 2] * _U(5))
    least = np.ones(len(g), dtype=bool)
    for d in range(1, reach + 1):
        apart = of[d:] != of[:-d]
        least[d:] &= apart | (g[d:] < g[:-d])
        least[:-d] &= apart | (g[:-d] < g[d:])
    cuts = np.unique(np.concatenate([a, at[least]]))
    end = np.minimum(np.append(cuts[1:], len(h)), z[np.searchsorted(a, cuts, side="right") - 1])
    more = (end - cuts - 1) // LONGEST
    return np.concatenate([cuts, _ranges(np.zeros_like(more), more) * LONGEST + LONGEST + np.repeat(cuts, more)])


def _stretches(words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end words of stretches of each text, wherever lines and sentences end.

    Of each PASSAGE words of a text the last run of RUN words with the least hash is a stretch. Where the next
    stretch starts behind its end, a longer one that reaches it is put beside it."""
    none = np.zeros(0, dtype=np.int64)
    if len(h) < PASSAGE:
        return none, none
    first = np.arange(len(h) - RUN + 1)
    g = _run_hashes(h, first, first + RUN)
    width, least = 1, first
    while width < PASSAGE - RUN + 1:
        step = min(width, PASSAGE - RUN + 1 - width)
        a, b = least[:-step], least[step:]
        least, width = np.where(g[b] <= g[a], b, a), width + step
    inside = words.doc[: len(least)] == words.doc[PASSAGE - 1 :]
    chosen = np.zeros(len(h), dtype=bool)
    chosen[least[inside]] = True
    a = np.flatnonzero(chosen)
    on = np.flatnonzero((words.doc[a[1:]] == words.doc[a[:-1]]) & (a[1:] - a[:-1] > RUN))
    return np.concatenate([a, a[on]]), np.concatenate([a + RUN, a[on + 1]])


def _spans(words: Words, hashes: np.ndarray, lines: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end words of paragraphs, and whether each is a line for MinHash. lines: these alone."""
    line, sentence = _starts(words, hashes)
    n = len(hashes)
    a = np.flatnonzero(line)
    z = np.append(a[1:], n)
    long = z - a >= LINE
    if lines:
        return a[long], z[long], np.ones(long.sum(), bool)
    s = np.flatnonzero(sentence)
    e = np.append(s[1:], n)
    own = (e - s >= SENTENCE) & ~np.isin(s * (n + 1) + e, (a * (n + 1) + z)[long])
    sa, sz = _stretches(words, hashes)
    new = ~np.isin(sa * (n + 1) + sz, np.concatenate([(a * (n + 1) + z)[long], (s * (n + 1) + e)[own]]))
    sa, sz = sa[new], sz[new]
    return np.concatenate([a[long], s[own], sa]), np.concatenate([z[long], e[own], sz]), np.concatenate([np.ones(long.sum(), bool), np.zeros(own.sum() + len(sa), bool)])


def _run_hashes(hashes: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A hash of each run of words [a, z)."""
    up, down = _power(len(hashes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * up[: len(hashes)], dtype=_U)])
        return mix((sums[z] - sums[a]) * down[a] + (z - a).astype(_U))


def _shingles(hashes: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (line, shingle) pairs of lines that don't overlap, words [a, z)."""
    own = SimpleNamespace(doc=np.full(len(hashes), -1), per_doc=z - a, first_word=a)
    own.doc[_ranges(a, z)] = np.repeat(np.arange(len(a)), z - a)  # each word knows its line
    g, ln, _ = grams(own, hashes, SHINGLE, short=False)
    return distinct(ln[ln >= 0], g[ln >= 0])[:2]


def _paragraphs(n_bands: int, rows: int):
    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words in passes(b.column("text")):
                hashes = words.hashes()
                a, z, is_line = _spans(words, hashes)
                if not len(a):
                    continue
                h = _run_hashes(hashes, a, z)
                doc = words.doc[a]
                order = np.lexsort((z, a))
                a, z, is_line, h, doc = a[order], z[order], is_line[order], h[order], doc[order]
                la, lz = a[is_line], z[is_line]
                ln, g = _shingles(hashes, la, lz)
                sig = bands(darts(ln, g, np.ones(len(g)), len(la), n_bands * rows), rows)
                per = np.bincount(doc, minlength=hi - lo)
                at = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                lines = np.concatenate([[0], np.cumsum(np.bincount(doc[is_line], minlength=hi - lo))]).astype(np.int32)
                lists = lambda off, x, t: pa.ListArray.from_arrays(pa.array(off), pa.array(x, t))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("rid").slice(lo, hi - lo),
                        b.column("doc_id").slice(lo, hi - lo),
                        lists(at, signed(h), pa.int64()),
                        lists(at, (a - words.first_word[doc]).astype(np.int32), pa.int32()),
                        lists(at, (z - a).astype(np.int32), pa.int32()),
                        lists(lines, signed(h[is_line]), pa.int64()),
                        lists((lines * n_bands).astype(np.int32), signed(sig.reshape(-1)), pa.int64()),
                    ],
                    ["rid", "doc_id", "h", "start", "n", "line", "bands"],
                )

    return run


_ROWS = "rid long, doc_id long, h array<long>, start array<int>, n array<int>, line array<long>, bands array<long>"


def _ranges(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    n = z - a
    return np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(a) else np.zeros(0, np.int64)


def _values(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=np.int64)


def _in_buckets(packed: DataFrame, shared: DataFrame, n_bands: int) -> DataFrame:
    """Rows (key, bucket) of the lines in `shared(bucket)`."""
    own = packed.sparkSession.sparkContext.broadcast(Bits.of(shared, "bucket").words)  # 4 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bits(own.value)
        for b in batches:
            key, bucket = np.repeat(_values(b.column("line")), n_bands), _values(b.column("bands"))
            on = may(bucket.view(_U))
            yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(bucket[on])], ["key", "bucket"])

    return packed.select("line", "bands").mapInArrow(run, "key long, bucket long").distinct().join(brief(shared), "bucket").select("bucket", "key")


def _units(packed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (rid, doc_id, h, start, n) of the paragraphs that may be in `known(h, ...)`."""
    own = packed.sparkSession.sparkContext.broadcast(Bits.of(known, "h").words)  # 4 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bits(own.value)
        for b in batches:
            h = _values(b.column("h"))
            on = np.flatnonzero(may(h.view(_U)))
            of = pa.array(np.repeat(np.arange(b.num_rows), np.diff(b.column("h").offsets.to_numpy()))[on])
            cols = [b.column("rid").take(of), b.column("doc_id").take(of), pa.array(h[on]), *[pa.array(_values(b.column(c))[on].astype(np.int32)) for c in ("start", "n")]]
            yield pa.RecordBatch.from_arrays(cols, ["rid", "doc_id", "h", "start", "n"])

    return packed.select("rid", "doc_id", "h", "start", "n").mapInArrow(run, "rid long, doc_id long, h long, start int, n int")


def _line_texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """Rows (key, text, n, bits) of the lines whose hash may be in `need(key)`: their text, number of shingles and sketch."""
    own = docs.sparkSession.sparkContext.broadcast(Bits.of(need, "key").words)  # 4 MB at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = Bits(own.value)
        for b in batches:
            keys, texts, size, bits = [], [], [], []
            for _, _, words in passes(b.column("text")):
                hashes = words.hashes()
                a, z, _ = _spans(words, hashes, lines=True)
                if not len(a):
                    continue
                h = _run_hashes(hashes, a, z)
                on = np.flatnonzero(may(h))
                _, first = np.unique(h[on], return_index=True)
                a, z, h = a[on[first]], z[on[first]], h[on[first]]
                ln, g = _shingles(hashes, a, z)
                keys += signed(h).tolist()
                texts += [words.data[words.starts[i] : words.ends[j - 1]].tobytes().decode("utf-8", "replace") for i, j in zip(a, z, strict=True)]
                size.append(np.bincount(ln, minlength=len(a)))
                bits.append(sketches(ln, g, np.ones(len(g)), len(a)).reshape(-1))
            flat = np.concatenate(bits) if bits else np.zeros(0, np.int64)
            at = (np.arange(len(keys) + 1) * SKETCH).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(np.concatenate(size) if size else [], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "text", "n", "bits"])

    return docs.select("text").mapInArrow(run, "key long, text string, n long, bits array<long>")


def repeated(docs: DataFrame, similar: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, start_word, n_words, class_id, first_doc_id, n_docs, removed), one for each paragraph of
    `docs(doc_id, text)` in a passage of RUN words or more that also stands in another document.

    class_id tells the class of equal or similar paragraphs, first_doc_id is its least doc_id, n_docs counts
    its documents' paragraphs, and removed is false only in the first document. Equal rows are one document;
    null doc_ids come after all others; null texts have no paragraphs. Equal paragraphs are those of equal
    64-bit hash and length; similar ones share a band and have the Jaccard similarity of word shingles."""
    n_bands, rows = tune(similar, recall)
    spark = docs.sparkSession
    own = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = checkpoint(own.mapInArrow(_paragraphs(n_bands, rows), _ROWS))
    # Lines that share a band, but for those that are equal.
    per = F.expr(f"transform(line, (h, i) -> struct(h as key, slice(bands, i * {n_bands} + 1, {n_bands}) as b))")
    buckets = packed.select(F.explode(per).alias("x")).select("x.key", F.explode("x.b").alias("bucket"))
    shared = checkpoint(buckets.groupBy("bucket").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x <> y").select("bucket"))
    some = checkpoint(_in_buckets(packed, shared, n_bands))
    release(spark)
    lines = checkpoint(_line_texts(own, some.select("key").distinct()).dropDuplicates(["key"]))
    roots = checkpoint(linked(some, lines.select("key", "n", "bits"), lines.select("key", "text"), _checked(similar, False), similar, ready=True))
    release(spark)
    # Paragraphs that stand twice, or in a component of lines; counting alone comes first, as it is narrow.
    twice = packed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    may = checkpoint(twice.unionByName(roots.select(F.col("node").alias("h"))))
    # Classes that stand in several documents: paragraphs are counted before they are joined.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    units = _units(packed, may).groupBy("h").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n_docs"), lead.alias("lead"))
    units = checkpoint(units.join(brief(roots).select(F.col("node").alias("h"), "root"), "h", "left").where("lo <> hi or root is not null").withColumn("class_id", F.coalesce("root", "h")).drop("root"))
    release(spark)
    found = checkpoint(units.groupBy("class_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_docs").alias("n_docs"), F.min("lead").alias("lead")).where("lo <> hi").select("class_id", "n_docs", "lead.doc_id", "lead.rid"))
    known = checkpoint(units.select("h", "class_id").join(brief(found).withColumnsRenamed({"doc_id": "first_doc_id", "rid": "lead"}), "class_id"))
    hits = _units(packed, known).join(brief(known), "h").drop("h").withColumn("end", F.col("start") + F.col("n"))
    if not packed.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        hits = hits.dropDuplicates(["rid", "start", "end"])  # equal rows
    release(spark)
    by_doc = Window.partitionBy("rid").orderBy("start", "end")
    before = F.coalesce(F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hits = hits.withColumn("before", before)
    hits = hits.withColumn("run", F.sum(F.when(F.col("start") > F.col("before") + GAP, 1).otherwise(0)).over(by_doc))
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", "before"))
    hits = hits.withColumn("covered", F.sum(covered).over(Window.partitionBy("rid", "run"))).where(F.col("covered") >= RUN)
    return hits.select("doc_id", F.col("start").alias("start_word"), F.col("n").alias("n_words"), "class_id", "first_doc_id", F.col("n_docs").cast("long").alias("n_docs"), (F.col("rid") != F.col("lead")).alias("removed"))


def strip(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """`docs` without their removed paragraphs, by doc_id; text left over stays as it is. A null doc_id or text loses
    nothing; columns of any name stay. A text that is a repeated passage as a whole is left empty."""
    found = repeated(docs) if found is None else found
    id_, own = free(docs, "_id"), free(docs, "_spans")
    spans = found.where("removed and doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(F.struct("start_word", "n_words")).alias(own))  # a document's own

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(texts, spans, strict=True):
            if t is None or s is None or not len(s):
                out.append(t)
                continue
            data = t.encode("utf-8", "surrogatepass")
            w = Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)], dtype=np.int64))
            keep = np.ones(len(data), dtype=bool)
            for x in s:
                a, z = x["start_word"], x["start_word"] + x["n_words"]
                keep[w.starts[a] : w.starts[z] if z < len(w.starts) else len(data)] = False
            out.append(np.frombuffer(data, dtype=np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass").strip())
        return pd.Series(out, dtype=object)

    joined = docs.join(spans, F.col("doc_id") == F.col(id_), "left")
    return joined.withColumn("text", cut("text", own)).select(*[F.col(f"`{c}`") for c in docs.columns])
