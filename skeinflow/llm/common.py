"""Helpers that several operators share: word and shingle hashes over Arrow
buffers, checkpoints in the cluster's shared folder, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared as shared_folder

U64 = np.uint64
_BASE, _COMB = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Bytes of text that one vectorised pass holds; a longer text is a pass of its own.
PASS_BYTES = 1 << 18
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Letters and digits of ASCII, and all bytes of other characters: punctuation parts words.
_IS_ALNUM = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _IS_ALNUM[_a:_b] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def tidy() -> None:
    """A worker, which Spark keeps for later tasks, gives freed memory back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run`, whose worker tidies up after the task."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as floats in [0, 1)."""
    return (x >> U64(11)).astype(np.float64) * (1.0 / (1 << 53))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PASS_BYTES + 1)
        with np.errstate(over="ignore"):
            up, down = np.full(size, _BASE), np.full(size, U64(pow(int(_BASE), -1, 1 << 64)))
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)]
    return _powers[0], _powers[1]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts: byte spans, hashes, the text each is of.
    alnum: punctuation of ASCII parts words, too."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, alnum: bool = False):
        self.data, self.offsets = data, offsets
        inside = (_IS_ALNUM if alnum else _IS_WORD)[data]
        n = len(data)
        first = np.zeros(n + 1, dtype=bool)
        first[:n] = inside
        first[1:n] &= ~inside[: n - 1] if n else first[1:n]
        cut = offsets[(offsets > 0) & (offsets < n)]
        first[cut] = inside[cut]
        last = np.zeros(n + 1, dtype=bool)  # last[i]: a word ends before byte i
        last[1:] = inside
        last[1:n] &= ~inside[1:n]
        last[cut] = inside[cut - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last)
        self.doc = np.searchsorted(offsets, self.starts, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first_word = np.concatenate([[0], np.cumsum(self.per_doc)])

    def hashes(self, lower: bool = False) -> np.ndarray:
        up, down = _power(len(self.data) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.data) + 1, dtype=U64)
            values = (LOWER[self.data] if lower else self.data).astype(U64)
            values += U64(1)
            values *= up[: len(values)]
            np.cumsum(values, out=sums[1:])
            return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])


def passes(texts: pa.Array, alnum: bool = False) -> Iterator[tuple[int, int, Words]]:
    """Words of a string column, some rows at a time: (first row, row after the last, words). Null counts as empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    whole = texts.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8) if whole is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PASS_BYTES, side="right")) - 1)
        yield at, to, Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], alnum)
        at = to


def grams(words: Words, hashes: np.ndarray, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of n words within each text, the text and first word of each.
    short: a text with fewer words, but one at least, has its whole run of words as its only gram."""
    total = len(hashes)
    with np.errstate(over="ignore"):
        if total >= n:
            h = np.zeros(total - n + 1, dtype=U64)
            for j in range(n):
                h *= _COMB
                h += hashes[j : total - n + 1 + j]
            same = words.doc[: total - n + 1] == words.doc[n - 1 :]
            at = np.flatnonzero(same)
            h, doc = mix(h[at]), words.doc[at]
        else:
            h, doc, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if short and len(few := np.flatnonzero((words.per_doc > 0) & (words.per_doc < n))):
            first, count = words.first_word[few], words.per_doc[few]
            g = np.zeros(len(few), dtype=U64)
            for j in range(n - 1):
                has = count > j
                g = np.where(has, g * _COMB + hashes[np.minimum(first + j, total - 1)], g)
            h, doc, at = np.concatenate([h, mix(g + count.astype(U64))]), np.concatenate([doc, few]), np.concatenate([at, first])
    return h, doc, at


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) pairs with their counts, by text and hash."""
    order = np.argsort(h)
    of = doc[order]
    order = order[np.argsort(of.astype(np.uint16) if doc.max(initial=0) < 1 << 16 else of, kind="stable")]  # a radix sort, if short
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


class Bits:
    """A Bloom filter for 64-bit hashes, of 64 bits or more for each, from 2**LEAST bits (1 MB) up to 2**MOST in all (4 MB).
    It only spares rows: what passes is joined exactly."""

    LEAST, MOST = 23, 25

    def __init__(self, words: np.ndarray):
        self.words, self.log = words, 6 + len(words).bit_length() - 1

    @classmethod
    def of(cls, df: DataFrame, column: str) -> "Bits":
        """Of a long column of a narrow, checkpointed table. At most 2**19 rows, of 64 bits each, reach the driver."""
        n = min(cls.MOST, max(cls.LEAST, (64 * df.count()).bit_length()))
        ats = F.array(*[F.shiftrightunsigned(F.shiftleft(F.col(column), i * n), 64 - n) for i in range(2)])
        bits = df.select(F.explode(ats).alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("b")).toArrow()
        words = np.zeros(1 << (n - 6), dtype=np.int64)
        words[bits.column("w").to_numpy()] = bits.column("b").to_numpy()
        return cls(words.view(U64))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Which hashes may be among them."""
        n = U64(64 - self.log)
        with np.errstate(over="ignore"):
            a, b = h >> n, (h << U64(self.log)) >> n
        on = lambda at: (self.words[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)
        return (on(a) & on(b)).astype(bool)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets shuffle and checkpoint files go that nothing needs any more. Spark deletes them when the driver's
    collectors find their handles unreachable, which a loop of small jobs may not bring about for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have: this one, or with underscores behind it."""
    has = {c.lower() for c in df.columns}
    while name.lower() in has:
        name += "_"
    return name


def brief(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Marks a checkpointed, narrow table for a broadcast if it has so few rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node of the
    component; nodes without an edge have no row.

    Alternates large-star and small-star steps. Both are a minimum for each node, combined before
    the shuffle, and a join back, so that a node with very many neighbours is no single group."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if large:
            return joined.where("b > a").select("b", F.col("m").alias("a")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("b"), F.col("m").alias("a")).where("a <> b").unionByName(least.select(F.col("a").alias("b"), F.col("m").alias("a")).where("a <> b")).distinct()

    now, state = checkpoint(edges.select("a", "b").where("a <> b").distinct()), None
    while True:  # ends after rounds in proportion to the logarithm of the largest component
        now = checkpoint(star(star(now, True).select("a", "b"), False).select("a", "b"))
        new = tuple(now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        release(now.sparkSession)
        if new == state:
            break
        state = new
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
