"""Periodic runs in texts: stretches of words that repeat with a period, and texts without the repeats.

A run is a stretch of words whose smallest period is at most half its length, that can't be made longer on either
side with that period. In the suffix automaton of the words a state stands for stretches that end at the same
places. The sets of end positions are merged from longer states into those they link to, the smaller set into the
larger one. Two positions that become neighbours in a state, no farther apart than the state is long, are a square:
the stretch before the second one has their distance as a period, and starts where the run starts, since the
state is where the two prefixes first meet. The farthest of a run's squares is where it ends.

A run of LEAST words or more has stretches of LEAST / 2 words that stand twice in the text, and these cover it. So
automata are built of the parts of a text that such stretches cover; a text without them costs hashing alone."""

from __future__ import annotations

from array import array
from bisect import bisect
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, free, grams, mix, passes, tidied

#: Words of a run at least.
LEAST = 12
#: End positions in a part of a set.
PART = 1024
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FOUND = pa.struct([("runs", pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), ("collapsed", pa.string())])


class Automaton:
    """The suffix automaton of a sequence of numbers: `size`, `link` and, for states that aren't copies, `end` by state.
    Most states have one edge, which takes no dictionary."""

    def __init__(self, word: Sequence[int]):
        self.size, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self._by, self._to, self._more = array("i", [-1]), array("i", [-1]), {}
        size, link, last = self.size, self.link, 0
        for at, w in enumerate(word):
            new, p = self._state(size[last] + 1, 0, at), last
            while p >= 0 and (q := self._edge(p, w)) < 0:
                self._put(p, w, new)
                p = link[p]
            if p >= 0:
                if size[q] != size[p] + 1:
                    q = self._split(p, q, w)
                link[new] = q
            last = new

    def _state(self, size: int, link: int, end: int) -> int:
        for held, x in ((self.size, size), (self.link, link), (self.end, end), (self._by, -1), (self._to, -1)):
            held.append(x)
        return len(self.size) - 1

    def _edge(self, p: int, w: int) -> int:
        if self._by[p] == w:
            return self._to[p]
        return self._more[p].get(w, -1) if p in self._more else -1

    def _put(self, p: int, w: int, to: int) -> None:
        if self._by[p] in (-1, w):
            self._by[p], self._to[p] = w, to
        else:
            self._more.setdefault(p, {})[w] = to

    def _split(self, p: int, q: int, w: int) -> int:
        """A copy of state q for its stretches that are no longer than those of p with w behind."""
        copy = self._state(self.size[p] + 1, self.link[q], -1)
        self._by[copy], self._to[copy] = self._by[q], self._to[q]
        if q in self._more:
            self._more[copy] = dict(self._more[q])
        while p >= 0 and self._edge(p, w) == q:
            self._put(p, w, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy


def _add(ends: list[list[int]], x: int) -> tuple[int | None, int | None]:
    """Puts x into an ordered set, kept in ordered parts; its neighbours there."""
    k = max(0, bisect(ends, [x]) - 1) if len(ends) > 1 else 0
    part = ends[k]
    i = bisect(part, x)
    before = part[i - 1] if i else ends[k - 1][-1] if k else None
    after = part[i] if i < len(part) else ends[k + 1][0] if k + 1 < len(ends) else None
    part.insert(i, x)
    if len(part) > 2 * PART:
        ends[k : k + 1] = [part[:PART], part[PART:]]
    return before, after


def _squares(word: Sequence[int], least: int) -> dict[tuple[int, int], int]:
    """The farthest end of the squares of each period and start."""
    states = Automaton(word)
    size, link = states.size, states.link
    sizes = np.frombuffer(size, dtype=np.int32)
    order = np.flatnonzero(sizes >= least)
    order = order[np.argsort(-sizes[order], kind="stable")].tolist()
    sets: dict[int, list[list[int]]] = {}
    count: dict[int, int] = {}
    found: dict[tuple[int, int], int] = {}
    for v in order:
        if (end := states.end[v]) >= 0:
            _join(sets, count, v, [[end]], 1, size[v], found)
        own, n = sets.pop(v), count.pop(v)
        if size[p := link[v]] >= least:
            _join(sets, count, p, own, n, size[p], found)
    return found


def _join(sets: dict, count: dict, p: int, own: list[list[int]], n: int, length: int, found: dict) -> None:
    """Merges a set of n end positions into that of state p; squares of new neighbours go to `found`."""
    if p not in sets:
        sets[p], count[p] = own, n
        return
    large, small = (own, sets[p]) if n > count[p] else (sets[p], own)
    last = None
    for part in small:
        for x in part:
            before, after = _add(large, x)
            # Of two of the small set, which met in a longer state, nothing is new.
            for a, z in ((before if before != last else None, x), (x, after)):
                if a is not None and z is not None and z - a <= length:
                    key = (z - a, a - length + 1)
                    if found.get(key, -1) < z:
                        found[key] = z
            last = x
    sets[p], count[p] = large, count[p] + n


def _is_power(root: Sequence[int]) -> bool:
    """Whether a sequence is a shorter one, repeated."""
    n, rest, p = len(root), len(root), 2
    while rest > 1:
        p = p if p * p <= rest else rest
        if rest % p == 0:
            if root == root[: n // p] * p:
                return True
            while rest % p == 0:
                rest //= p
        p += 1
    return False


def runs(word: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of `least` words or more, by start and period."""
    out = []
    for (period, start), end in _squares(word, (least + 1) // 2).items():
        length = end - start + 1
        if length >= max(least, 2 * period) and not _is_power(word[start : start + period]):
            out.append((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _covered(words: Words, n: int) -> np.ndarray:
    """Which words stand in a stretch of n words that the same text has twice. Equal hashes can only add some."""
    g, doc, at = grams(words, words.hashes(), n, short=False)
    with np.errstate(over="ignore"):
        key = mix(g + mix(doc.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    twice = np.zeros(len(key), dtype=bool)
    same = key[order[1:]] == key[order[:-1]]
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    step = np.zeros(len(words.doc) + 1, dtype=np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + n, -1)
    return np.cumsum(step)[:-1] > 0


def _found(words: list[bytes], covered: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The runs of one text, in its parts that repeated stretches cover."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    out = []
    for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        if z - a >= least:
            known: dict[bytes, int] = {}
            out += [(a + s, n, p) for s, n, p in runs([known.setdefault(w, len(known)) for w in words[a:z]], least)]
    return out


def _kept(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()]


def _texts(texts: pa.Array, least: int) -> pa.Array:
    found, left = [], []
    for lo, hi, words in passes(texts):
        covered = _covered(words, (least + 1) // 2) if len(words.doc) >= least else np.zeros(len(words.doc), dtype=bool)
        for i in range(hi - lo):
            own = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
            a, z = words.first_word[i : i + 2]
            got = _found(own, covered[a:z], least) if covered[a:z].any() else []
            found.append(got)
            left.append(b" ".join(_kept(own, got)))
    at = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]), pa.int32())
    flat = np.array([r for f in found for r in f], dtype=np.int64).reshape(-1, 3)
    rows = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(at, rows), pa.array(left, pa.binary()).cast(pa.string())], fields=list(_FOUND))


def _udf(least: int):
    @tidied
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _texts(texts, least)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"runs {RUNS}, collapsed string")


def periodic(docs: DataFrame, column: str = "text", least: int = LEAST) -> DataFrame:
    """Adds `runs`, an array of (start, length, period) by start and period, in words and numbered from 0, and `collapsed`,
    the words that no run holds behind its first period, joined by one space.

    Words are what white space of ASCII parts. A text is read whole by the task that has it: no shuffle. Null and empty
    texts have no runs and an empty `collapsed`; equal rows have equal runs; columns of these two names are replaced,
    others stay, whatever their names. Very long texts take memory in proportion to their longest repeated part."""
    docs = docs.drop("runs", "collapsed")
    got = free(docs, "_got")
    return docs.withColumn(got, _udf(least)(F.col(f"`{column}`"))).select("*", f"{got}.*").drop(got)


def longest(found: Column) -> Column:
    """The run of greatest length, of these the first, then that of the least period; null where there is none."""
    return F.element_at(F.array_sort(F.transform(found, lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), 1)


def looped(docs: DataFrame, id_: str = "doc_id", column: str = "text") -> DataFrame:
    """`docs` in which about a tenth of the texts, chosen by the checksum h of their id, go on in a loop: with g = h div 10,
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8), each of the n words from number a on is word a + (i - a) mod p.
    A null id leaves its text as it is."""
    words, loop = free(docs, "_words"), free(docs, "_loop")
    h = F.crc32(F.col(f"`{id_}`").cast("string"))
    split = F.filter(F.split(F.col(f"`{column}`"), r"[ \x09-\x0D]+"), lambda w: w != "")
    rows = docs.withColumn(words, F.when(h % 10 == 0, split)).withColumn(loop, F.floor(h / 10))
    n, g = F.size(words), F.col(loop)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < a, i).otherwise((a + (i - a) % p)).cast("int"))
    text = F.array_join(F.transform(at, lambda i: F.get(F.col(words), i)), " ")
    return rows.withColumn(column, F.when(n > 0, text).otherwise(F.col(f"`{column}`"))).drop(words, loop)


def report(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of `docs(doc_id, text)`, the
    longest run's figures being null where there is none."""
    rows = periodic(docs).withColumn("_long", F.when(F.size("runs") > 0, longest(F.col("runs"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_long.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * _long.length) div _long.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
