"""Hierarchical Pitman-Yor language model: seating sweep by sweep, averaged predictions.

Each context (the word before) is a restaurant whose customers are the words that follow it; each table that
is opened there for a word sends a customer to the parent restaurant of all contexts, whose own parent deals
alike with the V known words and the unknown one. Every training word is a context. A sweep takes the customers of
each dish out and seats them anew, one after another, given all other dishes' tables of the sweep before; predictions are
averaged over the last sweeps.

Tokens are dealt to buckets by word, those of the HEAD most frequent words by word and context, so no word is one
task's load, and stay packed in a table that is bucketed alike until all is scored. Each sweep is a pass over them.
What buckets must know of each other are figures of words and contexts: of the HEAD most frequent ones as arrays of
that length, of all others by an exchange, for which the hashes are dealt to parts that add up what the buckets send and
send the sums back. A seating depends on hashes of dish, sweep and customer alone, so any task can repeat it, also
after a loss."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, checkpoint, mix, passes, release, signed, tidied, tidy, unit

#: Words whose figures all tasks hold as arrays; others are exchanged. Both are contexts of their own.
HEAD = 65_536
#: Sweeps, and how many of the last ones are averaged.
SWEEPS, KEPT = 3, 2
#: Concentration of both levels; discounts come from the numbers of dishes with one and two customers.
THETA = 1.0
#: Customers that are seated one by one; further ones in blocks of this share of those before.
ONE_BY_ONE, BLOCK_SHARE = 128, 32
#: Tokens of a bucket, and the least number of buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_500_000, 48
#: Tokens that are packed together, and texts at most.
BLOCK_TOKENS, BLOCK_TEXTS = 1_000_000, 1 << 18
END = mix(np.array([0x656E64], dtype=U64))[0]
_TAIL, _MASK = U64(1 << 63), (1 << 64) - 1
FOLDS, HELD = 7, 2


def held_out(doc_id: int | None) -> bool:
    """Whether a document is held out of training; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD


def _tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, token hashes, text of each), an END after each text's words."""
    for lo, hi, words in passes(texts):
        at = words.first_word[1:]
        h = np.insert(words.hashes(lower=True), at, END)
        yield lo, hi, h, np.insert(words.doc, at, np.arange(hi - lo))


def _counted(held: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(held) if held else np.zeros(0, U64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n.astype(np.int64))], ["h", "c"])


def word_counts(docs: DataFrame) -> DataFrame:
    """Rows (h, c): the count of each word hash in the training texts."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            train = np.array([not held_out(i) for i in b.column("doc_id").to_pylist()], dtype=bool)
            for lo, _, h, doc in _tokens(b.column("text")):
                held.append(h[train[lo + doc]])
                size += len(held[-1])
                if size >= 4 * BLOCK_TOKENS:
                    yield _counted(held)
                    held, size = [], 0
        yield _counted(held)

    return docs.select("doc_id", "text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _pressed(data: np.ndarray) -> bytes:
    """Numbers byte by byte, compressed: the high bytes of small ones cost nothing."""
    planes = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.dtype.itemsize).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpressed(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, size * n)), dtype=np.uint8)
    return np.array(planes.reshape(size, n).T, order="C").view(kind).reshape(-1)


def _squeeze(keys: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return _pressed(np.diff(keys, prepend=U64(0)))


def _loosen(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpressed(data, U64, n), dtype=U64)


def _news(k: np.ndarray) -> np.ndarray:
    """Where an ordered array has a new value."""
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    return new


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct values of arrays, in order. A stable sort is quick where these are in order already."""
    x = np.sort(np.concatenate(parts), kind="stable") if parts else np.zeros(0, U64)
    return x[_news(x)]


_PACKED = "bucket int, src long, n int, bits int, keys binary, tail binary"


def _pack(head: np.ndarray, buckets: int):
    """Rows of packed tokens for each block of texts and bucket: keys (word, context, train, text) in order, the
    numbers of a word and a context having so many `bits`. Below HEAD they are frequent words' ids, else HEAD plus the
    place of their hash in `tail`. Negative buckets have the texts: their ids, whether these are null or train, and
    their numbers of tokens."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        for b in batches:
            hs: list[np.ndarray] = []
            docs: list[np.ndarray] = []
            size, first = 0, 0

            def block(hi: int) -> pa.RecordBatch:
                return _block((part << 24) | no, b.column("doc_id").slice(first, hi - first), np.concatenate(hs), np.concatenate(docs), head, buckets)  # noqa: B023

            for lo, hi, h, doc in _tokens(b.column("text")):
                if hs and (size + len(h) > BLOCK_TOKENS or hi - first > BLOCK_TEXTS):
                    yield block(lo)
                    hs, docs, size, first, no = [], [], 0, lo, no + 1
                hs.append(h)
                docs.append(doc + (lo - first))
                size += len(h)
            if hs:
                yield block(b.num_rows)
                no += 1

    return run


def _numbered(h: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of hashes, places in the head or else HEAD plus the place in the tail, and the tail: those not in the head."""
    own = _merged([h])
    at = np.minimum(np.searchsorted(head, own), len(head) - 1)
    far = head[at] != own
    ids = np.where(far, HEAD + np.cumsum(far) - 1, at)
    return ids[np.searchsorted(own, h)], own[far]


def _block(src: int, ids: pa.Array, h: np.ndarray, doc: np.ndarray, head: np.ndarray, buckets: int) -> pa.RecordBatch:
    train = np.array([not held_out(i) for i in ids.to_pylist()], dtype=bool)
    nulls = np.array(ids.is_null().to_pylist(), dtype=bool)
    per = np.bincount(doc, minlength=len(train)).astype(np.int64)
    out = [(-1 - src % buckets, src, len(train), 0, np.array(ids.fill_null(0), dtype=np.int64).tobytes(), nulls.tobytes() + train.tobytes() + per.tobytes())]
    word, tail = _numbered(h, head)
    ctx = np.empty_like(word)
    ctx[0], ctx[1:] = np.searchsorted(head, END), word[:-1]  # a text starts behind the end of another
    own = mix(np.concatenate([head, np.zeros(HEAD - len(head), U64), tail]))
    with np.errstate(over="ignore"):
        bucket = np.where(word < HEAD, mix(own[word] + own[ctx] * U64(3)), own[word]) % U64(buckets)
    bucket = bucket.astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    word, ctx, doc = word[order], ctx[order], doc[order]
    low = int(len(train)).bit_length()
    for i in np.flatnonzero(np.diff(edges)):
        w, c, d = word[edges[i] : edges[i + 1]], ctx[edges[i] : edges[i + 1]], doc[edges[i] : edges[i + 1]]
        far = _merged([w[w >= HEAD], c[c >= HEAD]])
        w, c = (np.where(x < HEAD, x, HEAD + np.searchsorted(far, x)) for x in (w, c))
        bits = max(16, (HEAD + len(far)).bit_length())
        if 2 * bits + 1 + low > 64:
            raise ValueError("a block of texts has too many words")
        key = (w.astype(U64) << U64(bits + 1 + low)) | (c.astype(U64) << U64(1 + low)) | (train[d].astype(U64) << U64(low)) | d.astype(U64)
        out.append((int(i), src, len(key), bits << 8 | low, _squeeze(np.sort(key)), tail[far - HEAD].tobytes()))
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.binary()), pa.array(cols[5], pa.binary())], _names(_PACKED))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


@dataclass
class State:
    """What all tasks know before a sweep: for each frequent word its tables as a context, its customers and tables as a
    dish of the parent restaurant, and the parent's totals. All of fixed length."""

    tables: np.ndarray
    word_customers: np.ndarray
    word_tables: np.ndarray
    parent_customers: float
    parent_tables: float


@dataclass
class Plan:
    """Fixed figures of a model, and the states before each sweep done so far."""

    n: int
    v: int
    counts: np.ndarray  # of frequent words, as words and as contexts: each is followed by one token
    discount: tuple[float, float] = (0.5, 0.5)
    states: list[State] = field(default_factory=list)

    @property
    def base(self) -> float:
        return 1.0 / (self.v + 1)

    def parent(self, s: State, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The parent restaurant's probabilities of words with so many customers and tables there."""
        d = self.discount[1]
        return (np.maximum(c - d * t, 0) + (THETA + d * s.parent_tables) * self.base) / (THETA + s.parent_customers)


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Binomial draws from uniform numbers: by inversion where the mean is small, else by the normal shape."""
    mean, out = n * p, np.zeros(len(n))
    large = mean >= 30
    spread = np.sqrt(mean * (1 - p))
    normal = np.sqrt(-2 * np.log(np.maximum(u, 1e-300))) * np.cos(2 * np.pi * v)
    out[large] = np.clip(np.floor(mean + spread * normal + 0.5), 0, n)[large]
    left = np.flatnonzero(~large)
    term = np.exp(n * np.log1p(-np.minimum(p, 1 - 1e-12)))
    below, j = term.copy(), 0
    while len(left := left[(below[left] < u[left]) & (out[left] < n[left]) & (term[left] > 1e-18)]):
        term[left] *= (n[left] - j) / (j + 1) * p[left] / (1 - p[left])
        below[left] += term[left]
        out[left] += 1
        j += 1
    return out


def seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, discount: float, key: np.ndarray, one_by_one: int = ONE_BY_ONE) -> np.ndarray:
    """Tables that c customers of each dish take, in a restaurant with so many tables of other dishes: a customer opens
    a table with odds (concentration and discount times all tables) times the parent's probability p, against the
    dish's customers less the discounts of its tables. After the first ones customers come in blocks, whose odds are
    those of its middle one."""
    t = np.minimum(c, 1).astype(np.float64)
    left = np.flatnonzero(c > 1)
    k = 1
    while len(left):
        n = 1 if k < one_by_one else k // BLOCK_SHARE
        n_now = np.minimum(n, c[left] - k)
        opens = (THETA + discount * (others[left] + t[left])) * p[left]
        odds = opens / (np.maximum(k + (n_now - 1) / 2 - discount * t[left], 1e-9) + opens)
        u = unit(mix(key[left] + U64(k * 0x9E3779B97F4A7C15 & _MASK)))
        if n == 1:
            t[left] += u < odds
        else:
            t[left] += binomial(n_now, odds, u, unit(mix(key[left] + U64(k * 0xD1342543DE82EF95 + 1 & _MASK))))
        k += n
        left = left[c[left] > k]
    return t


def _hashes(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """By id, a hash of each word."""
    return mix(np.concatenate([head, np.zeros(HEAD - len(head), U64), tail]))


class Bucket:
    """A bucket's pairs, in order: word and context ids below HEAD, else places in `tail` behind it; training counts
    (0 for pairs of held-out texts alone); tables. Of the tail's words: customers and tables as dishes of the parent, and
    as contexts, over all buckets, customers (c) and tables."""

    #: What changes from sweep to sweep, with the array that tells its length.
    STATE = (("t", float, "pair"), ("dish_t", float, "tail"), ("ctx_c", np.int64, "tail"), ("ctx_t", float, "tail"))

    def __init__(self, tail: np.ndarray, pair: np.ndarray, c: np.ndarray):
        self.tail, self.pair, self.c = tail, pair, c
        self.word, self.ctx = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
        self.t = np.minimum(c, 1).astype(float)
        self.dish_t = np.minimum(self.dish_c(), 1)
        self.ctx_c, self.ctx_t = np.zeros(len(tail), np.int64), np.zeros(len(tail))

    def state(self) -> list[bytes]:
        return [_pressed(getattr(self, name)) for name, _, _ in self.STATE]

    def restore(self, data: list[bytes]) -> None:
        for (name, kind, size), x in zip(self.STATE, data, strict=True):
            setattr(self, name, _unpressed(x, kind, len(getattr(self, size))))

    @classmethod
    def of_tokens(cls, rows: list[dict], placed: bool = False) -> tuple["Bucket", list[tuple[np.ndarray, np.ndarray]]]:
        """The bucket of packed tokens, and if they are asked for, for each row the place of each token's pair, and its text."""
        own = [np.frombuffer(r["tail"], dtype=U64) for r in rows]
        tail = _merged(own)
        seen, trained, places = [], [], []
        for r, t in zip(rows, own, strict=True):
            k, bits, low = _loosen(r["keys"], r["n"]), r["bits"] >> 8, r["bits"] & 255
            to = np.concatenate([np.arange(HEAD), HEAD + np.searchsorted(tail, t)]).astype(U64)
            both = k >> U64(1 + low)
            at = np.flatnonzero(_news(both))
            pair = both[at]
            pair = (to[pair >> U64(bits)] << U64(32)) | to[pair & U64((1 << bits) - 1)]  # ids keep the order of hashes
            seen.append(pair)
            trained.append(np.add.reduceat((k >> U64(low)) & U64(1), at).astype(np.int64))
            if placed:
                places.append((np.diff(np.append(at, len(k))), (k & U64((1 << low) - 1)).astype(np.int32)))
        pairs = _merged(seen)
        c = np.zeros(len(pairs), np.int64)
        for i, (pair, n) in enumerate(zip(seen, trained, strict=True)):
            at = np.searchsorted(pairs, pair)
            c[at] += n  # a row has each pair once
            if placed:
                places[i] = (np.repeat(at, places[i][0]), places[i][1])
        return cls(tail, pairs, c), places

    def dish_c(self) -> np.ndarray:
        """The tail's words' customers in the parent. All pairs of a word outside the head are in its bucket."""
        far = self.word >= HEAD
        return np.bincount(self.word[far] - HEAD, weights=self.t[far], minlength=len(self.tail))

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.ctx, weights=x, minlength=HEAD + len(self.tail))

    def tables_at(self, s: State) -> np.ndarray:
        """All tables of each pair's context."""
        return np.concatenate([s.tables, self.ctx_t])[self.ctx]

    def parents(self, plan: Plan, s: State) -> np.ndarray:
        """The parent's probability of each pair's word."""
        return plan.parent(s, np.concatenate([s.word_customers, self.dish_c()]), np.concatenate([s.word_tables, self.dish_t]))[self.word]

    def sweep(self, plan: Plan, head: np.ndarray, i: int) -> None:
        """Seats all customers anew, given the state before."""
        s, d = plan.states[i], plan.discount
        p, own = self.parents(plan, s), _hashes(head, self.tail)
        with np.errstate(over="ignore"):
            key = mix(own[self.word] + own[self.ctx] * U64(3)) + U64(i + 1)
        self.t = seat(self.c, self.tables_at(s) - self.t, p, d[0], key)
        self.dish_t = seat(self.dish_c().astype(np.int64), s.parent_tables - self.dish_t, np.full(len(self.tail), plan.base), d[1], own[HEAD:] + U64(i + 1))

    def predict(self, plan: Plan, s: State) -> np.ndarray:
        """The probability of each pair's word after its context."""
        d = plan.discount[0]
        tables = self.tables_at(s)
        customers = np.concatenate([plan.counts, self.ctx_c])[self.ctx]
        return (np.maximum(self.c - d * self.t, 0) + (THETA + d * tables) * self.parents(plan, s)) / (THETA + customers)

    def counts(self, plan: Plan) -> np.ndarray:
        """The training count of each pair's word."""
        far = self.word >= HEAD
        own = np.bincount(self.word[far] - HEAD, weights=self.c[far], minlength=len(self.tail))
        return np.concatenate([plan.counts, own])[self.word]


#: Rows that buckets and parts send each other, by kind: a bucket's state after a sweep; its figures of contexts outside
#: the head, for a part; a part's sums of them, for a bucket; a bucket's figures of frequent words and totals; a state that
#: predictions use, with what it was told after its sweep.
MODEL, ASKED, ANSWERED, FIGURES, USED = range(5)
_SENT = "kind int, at int, src int, n int, data array<binary>"
#: Totals among the figures: customers of the parent; tables of the tail's words there; pairs of one and of two customers;
#: the tail's words of one and of two contexts.
TOTALS = 6


def _sent(rows: list[tuple]) -> pa.Table:
    tidy()  # what a group held but for these rows
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = [pa.int32()] * 4 + [pa.list_(pa.binary())]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], _names(_SENT))


def _asked(b: Bucket, at: int, parts: int) -> Iterator[tuple]:
    """For each part its hashes of the bucket's tail, with customers and tables of these contexts here."""
    part = (b.tail % U64(parts)).astype(np.int64)
    c, t = b.by_context(b.c)[HEAD:].astype(np.int64), b.by_context(b.t)[HEAD:].astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edges)):
        own = order[edges[p] : edges[p + 1]]
        yield (ASKED, int(p), at, len(own), [_squeeze(b.tail[own]), _pressed(c[own]), _pressed(t[own])])


def _figures(b: Bucket, at: int, first: bool) -> tuple:
    near = b.word < HEAD
    ctx, word = b.by_context(b.t)[:HEAD], np.bincount(b.word[near], weights=b.t[near], minlength=HEAD)
    dishes = b.dish_c()
    total = [b.t.sum(), b.dish_t.sum(), *[(x == k).sum() if first else 0 for x in (b.c, dishes) for k in (1, 2)]]
    return (FIGURES, 0, at, 0, [_pressed(ctx), _pressed(word), np.array(total, dtype=float).tobytes()])


def _started(parts: int):
    """A bucket's packed tokens to its model, figures and questions."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        b, _ = Bucket.of_tokens(table.to_pylist())
        return _sent([(MODEL, at, at, 0, b.state()), _figures(b, at, True), *_asked(b, at, parts)])

    return run


def _answered(key: tuple, table: pa.Table) -> pa.Table:
    """A part's sums of customers and tables of its contexts, for each bucket that asked."""
    rows = table.to_pylist()
    hashes = [_loosen(r["data"][0], r["n"]) for r in rows]
    all_ = np.unique(np.concatenate(hashes))
    sums = np.zeros((2, len(all_)), np.int64)
    places = [np.searchsorted(all_, h) for h in hashes]
    for r, place in zip(rows, places, strict=True):
        for k in (0, 1):
            sums[k, place] += _unpressed(r["data"][1 + k], np.int64, r["n"])
    return _sent([(ANSWERED, r["src"], key[0].as_py(), r["n"], [_pressed(sums[0, p]), _pressed(sums[1, p])]) for r, p in zip(rows, places, strict=True)])


def _told(b: Bucket, rows: list[dict], parts: int) -> None:
    """Takes the last state and the parts' answers into a bucket: these come in the order of its hashes of each part."""
    b.restore(next(r["data"] for r in rows if r["kind"] == MODEL))
    part = (b.tail % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for r in (r for r in rows if r["kind"] == ANSWERED):
        own = order[edges[r["src"]] : edges[r["src"] + 1]]
        b.ctx_c[own] = _unpressed(r["data"][0], np.int64, r["n"])
        b.ctx_t[own] = _unpressed(r["data"][1], np.int64, r["n"])


def _swept(plan: Broadcast, head: Broadcast, parts: int, i: int):
    """A bucket's tokens, its state after i sweeps and what it was told, to the state after the next with figures and
    questions; and the one that it was, if predictions use it."""

    def run(key: tuple, tokens: pa.Table, sent: pa.Table) -> pa.Table:
        if not tokens.num_rows:
            return _sent([])
        at, (b, _) = key[0].as_py(), Bucket.of_tokens(tokens.to_pylist())
        _told(b, sent.to_pylist(), parts)
        out = [(USED, at, i, 0, b.state())] if i > SWEEPS - KEPT else []
        b.sweep(plan.value, head.value, i)
        return _sent([*out, (MODEL, at, at, 0, b.state()), _figures(b, at, False), *_asked(b, at, parts)])

    return run


def _state(sent: DataFrame, plan: Plan, head: np.ndarray, i: int) -> np.ndarray:
    """Adds the state after so many sweeps to the plan. Partitions add up their buckets' figures; so many rows of three
    arrays reach the driver one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(HEAD), np.zeros(HEAD), np.zeros(TOTALS)]
        for b in batches:
            for data in b.column("data").to_pylist():
                for s, x in zip(sums, (_unpressed(data[0], float, HEAD), _unpressed(data[1], float, HEAD), np.frombuffer(data[2])), strict=True):
                    s += x
        at = [np.flatnonzero(x) for x in sums]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(3), list(map(len, at))).astype(np.int32)), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([s[a] for s, a in zip(sums, at, strict=True)]))], ["kind", "at", "x"])

    got = sent.where(F.col("kind") == FIGURES).select("data").mapInArrow(run, "kind int, at int, x double").groupBy("kind", "at").agg(F.sum("x").alias("x")).toArrow()
    ctx, word, tot = np.zeros(HEAD), np.zeros(HEAD), np.zeros(TOTALS)
    for k, out in enumerate((ctx, word, tot)):
        own = got.filter(pc.equal(got["kind"], k))
        out[own["at"].to_numpy()] = own["x"].to_numpy()
    if i == 0:
        plan.discount = (_discount(tot[2], tot[3]), _discount(tot[4] + (word == 1).sum(), tot[5] + (word == 2).sum()))
        tables = np.minimum(word, 1)
    else:
        s = plan.states[-1]
        own = _hashes(head, np.zeros(0, U64))
        tables = seat(word.astype(np.int64), s.parent_tables - s.word_tables, np.full(HEAD, plan.base), plan.discount[1], own + U64(i))
    plan.states.append(State(ctx, word, tables, tot[0], tot[1] + tables.sum()))
    return tot


def _discount(one: float, two: float) -> float:
    return float(np.clip(one / (one + 2 * two), 0.05, 0.95)) if one else 0.5


_SCORED = "src long, bucket int, n int, data binary"
#: A text's sums in a bucket: its number, less that of the one before; score; base score; known tokens.
_SUMS = np.dtype([("text", "<i4"), ("score", "<f8"), ("base", "<f8"), ("known", "<i4")])


def _scored(plan: Broadcast, parts: int):
    """Of a bucket's tokens and its states after the kept sweeps, for each block of texts the sums of its tokens: score,
    base score and known tokens of each text."""

    def run(key: tuple, tokens: pa.Table, sent: pa.Table) -> pa.Table:
        out, at = [], key[0].as_py()
        if tokens.num_rows:
            rows, told, of = tokens.to_pylist(), sent.to_pylist(), plan.value
            b, places = Bucket.of_tokens(rows, placed=True)
            _told(b, told, parts)
            p = b.predict(of, of.states[SWEEPS])
            for r in sorted((r for r in told if r["kind"] == USED), key=lambda r: r["src"]):
                b.restore(r["data"])
                p += b.predict(of, of.states[r["src"]])
            total = b.counts(of)
            score, base = np.log10(p / KEPT), np.log10((total + 1) / (of.n + of.v + 1))
            for r, (place, doc) in zip(rows, places, strict=True):
                n = int(doc.max()) + 1
                used = np.flatnonzero(np.bincount(doc, minlength=n))
                sums = np.zeros(len(used), _SUMS)
                sums["text"] = np.diff(used, prepend=0)
                for field_, x in (("score", score), ("base", base), ("known", total > 0)):
                    sums[field_] = np.bincount(doc, weights=x[place], minlength=n)[used]
                out.append((r["src"], at, len(used), _pressed(sums)))
        tidy()
        cols = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], _names(_SCORED))

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _by_text(table: pa.Table) -> pa.Table:
    """Adds up what the buckets say of one batch of texts."""
    rows = table.to_pylist()
    texts = next(r for r in rows if r["ids"] is not None)
    n = texts["n"]
    ids, rest = np.frombuffer(texts["ids"], dtype=np.int64), texts["data"]
    nulls, train, per = np.frombuffer(rest[:n], dtype=bool), np.frombuffer(rest[n : 2 * n], dtype=bool), np.frombuffer(rest[2 * n :], dtype=np.int64)
    sums = np.zeros((3, n))
    for r in sorted((r for r in rows if r["ids"] is None), key=lambda r: r["bucket"]):
        got = _unpressed(r["data"], _SUMS, r["n"])
        used = np.cumsum(got["text"])
        for k, field_ in enumerate(("score", "base", "known")):
            sums[k, used] += got[field_]
    return pa.table({"doc_id": pa.array(ids, mask=nulls), "held_out": pa.array(~train), "n_tokens": pa.array(per), "n_known": pa.array(sums[2].astype(np.int64)), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})


def _sampled(packed: DataFrame, plan: Plan, head: np.ndarray, shared: Broadcast, buckets: int) -> DataFrame:
    """The sweeps over packed tokens, and what they make of each text; written before it is returned."""
    spark = packed.sparkSession
    release(spark)
    texts = packed.where("bucket < 0").select("src", "bucket", "n", F.col("keys").alias("ids"), F.col("tail").alias("data"))
    tokens = packed.where("bucket >= 0")
    sent, used = checkpoint(tokens.groupBy("bucket").applyInArrow(_started(buckets), _SENT)), None
    release(spark)
    for i in range(SWEEPS + 1):
        _state(sent, plan, head, i)
        known = spark.sparkContext.broadcast(plan)  # three arrays of fixed length for each sweep
        asked = sent.where(F.col("kind") == ASKED).repartition(buckets, "at").groupBy("at").applyInArrow(_answered, _SENT)
        both = sent.where(F.col("kind") == MODEL).unionByName(asked)
        if i < SWEEPS:
            sent = checkpoint(tokens.groupBy("bucket").cogroup(both.groupBy("at")).applyInArrow(_swept(known, shared, buckets, i), _SENT))
            if i > SWEEPS - KEPT:
                new = sent.where(F.col("kind") == USED)
                used = new if used is None else used.unionByName(new)
            del asked, both
            release(spark)
    told = tokens.groupBy("bucket").cogroup((both if used is None else both.unionByName(used)).groupBy("at")).applyInArrow(_scored(known, buckets), _SCORED).withColumn("ids", F.lit(None).cast("binary"))
    return checkpoint(told.unionByName(texts).groupBy("src").applyInArrow(_by_text, _OUT))  # a few numbers for each text


def score(docs: DataFrame) -> DataFrame:
    """One row for each of `docs(doc_id, text)`: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. A null text is an empty one, whose only token is its end. Equal rows each have a row; without
    texts there are none. A null doc_id counts as the empty text for holding out."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = checkpoint(word_counts(docs))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(HEAD - 1).toArrow()  # of fixed length
    of = dict(zip(top["h"].to_numpy().view(U64).tolist(), top["c"].to_pylist(), strict=True))
    of.setdefault(int(END), 0)
    head = np.array(sorted(of), dtype=U64)
    del counts, top  # what was written goes with what names it
    plan = Plan(n, v, np.zeros(HEAD))
    plan.counts[: len(head)] = [of[int(h)] for h in head]
    buckets = max(LEAST_BUCKETS, -(-n // BUCKET_TOKENS))
    release(spark)
    shared = spark.sparkContext.broadcast(head)  # half a megabyte

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pack(shared.value, buckets)(batches)

    # A bucketed table: each sweep joins tokens with what buckets are told, and only that is shuffled.
    name = f"tokens_{uuid.uuid4().hex}"
    try:
        docs.mapInArrow(pack, _PACKED).repartition(buckets, "bucket").write.option("compression", "zstd").bucketBy(buckets, "bucket").saveAsTable(name)
        got = _sampled(spark.table(name), plan, head, shared, buckets)
    finally:  # also where it breaks off
        spark.sql(f"drop table if exists {name}")
    release(spark)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
