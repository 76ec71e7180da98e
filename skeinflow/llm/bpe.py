"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text up to LEAF characters is encoded in one go. A longer one is cut into leaves, which are encoded in
parallel as rows of their own, and the leaves' token sequences are joined pairwise, level by level. At a
join, the text from some tokens before it to some tokens after it is encoded anew; when its first token
agrees with the left side and a later one with the right side, what lies between replaces both ends, else
the window doubles. Every pair of neighbours in the joined sequence then also stands in an encoding of the
text around it, which for BPE makes the sequence the encoding of the whole."""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import free, tidied

#: Characters of a leaf.
LEAF = 32_768
#: Bytes of the words that a worker keeps with their ids, of which Python takes about so many for an entry beside its
#: signs, and words that the library encodes at once.
KEPT_BYTES, ENTRY_BYTES, WORDS_AT_ONCE = 64 << 20, 200, 1_000
#: Leaves that are encoded before they are handed on.
LEAVES_AT_ONCE = 32
#: A change of the text can alter a split so many characters before it: the longest contraction.
REACH = 3
#: Characters for which Python's and the tokenizer's Unicode tables surely agree, composed as they are.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-įı-ſ]*")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


#: The splits of this vocabulary's files, for plain characters.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^\s{_class('L')}{_class('N')}]+")
#: The pattern in the tokenizer's file that WORD renders; with another pattern no text counts as plain.
WORD_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Words:
    """The library's ids, as text, of words and of runs of words without white space between them.

    Those asked for last are kept, up to KEPT_BYTES: when the young half is full it becomes the old half, and what
    the old half held and nothing asked for since goes."""

    def __init__(self, tok: Tokenizer, suffix: str):
        self.tok = tok
        self.numbers = [str(i) for i in range(tok.get_vocab_size())]
        self.sign = {n: tok.decode([i], skip_special_tokens=False) for i, n in enumerate(self.numbers)}
        self.closes = [tok.id_to_token(i).endswith(suffix) for i in range(len(self.numbers))]
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.bytes = 0

    def _encoded(self, words: list[str]) -> list[list[int]]:
        """The ids of each word. Many words are encoded as one text, whose ids part after those that close a word."""
        out: list[list[int]] = [[]]
        for i in self.tok.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids:
            out[-1].append(i)
            if self.closes[i]:
                out.append([])
        if len(out) == len(words) + 1 and not out[-1]:
            return out[:-1]
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, runs: list[str]) -> str:
        """The ids of all runs, in their order."""
        if 2 * self.bytes > KEPT_BYTES:  # between two texts, so that what a text needs stays
            self.old, self.young, self.bytes = self.young, {}, 0
        try:
            return " ".join(map(self.young.__getitem__, runs))
        except KeyError:
            self._learn(set(runs))
            return " ".join(map(self.young.__getitem__, runs))

    def _put(self, key: str, ids: str) -> None:
        self.young[key] = ids
        self.bytes += ENTRY_BYTES + len(key) + len(ids)

    def _lack(self, keys: set[str]) -> list[str]:
        """The keys that are not kept; the others are young from now on."""
        out = []
        for k in keys:
            if k not in self.young:
                if (ids := self.old.get(k)) is None:
                    out.append(k)
                else:
                    self._put(k, ids)
        return out

    def _learn(self, runs: set[str]) -> None:
        lack = self._lack(runs)
        parts = [WORD.findall(r) for r in lack]
        new = self._lack({w for p in parts for w in p})
        for at in range(0, len(new), WORDS_AT_ONCE):
            some = new[at : at + WORDS_AT_ONCE]
            for word, ids in zip(some, self._encoded(some), strict=True):
                self._put(word, " ".join([self.numbers[i] for i in ids]))
        for run, part in zip(lack, parts, strict=True):
            if len(part) > 1:
                self._put(run, " ".join([self.young[w] for w in part]))

    def decoded(self, ids: str) -> str:
        return " ".join(map(self.sign.__getitem__, ids.split(" "))) if ids else ""


class Codec:
    """Encodes and decodes texts with a tokenizer's file."""

    def __init__(self, path: str):
        self.tok = load(path)
        spec = json.loads(self.tok.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        self.words = _Words(self.tok, suffix or "")
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_at = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        norms = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = bool(steps) and steps[0].get("pattern", {}).get("Regex") == WORD_SOURCE and norms == ["NFC", "Replace", "Lowercase"] and spec["decoder"] is None and bool(suffix)

    def is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def texts(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by spaces, and the decoded text."""
        if self.by_word and PLAIN.fullmatch(text) and not self.is_special(text):
            ids = self.words.ids(text.lower().split())
            return (ids.count(" ") + 1 if ids else 0), ids, self.words.decoded(ids)
        ids = self.ids(text)
        return len(ids), " ".join(map(str, ids)), self.tok.decode(ids, skip_special_tokens=False)

    def digests(self, text: str) -> tuple[int, str, str]:
        n, ids, decoded = self.texts(text)
        return n, _sha(ids), _sha(decoded)

    def part(self, text: str) -> "Part":
        e = self.tok.encode(text, add_special_tokens=False)
        spans = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
        return Part(text, np.array(e.ids, dtype=np.int64), spans[:, 0], spans[:, 1])


@lru_cache(maxsize=1)
def codec_of(path: str) -> Codec:
    """A worker's codec, whose words later tasks find again."""
    return Codec(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@dataclass
class Part:
    """Consecutive text, its ids, and the characters [start, end) that each id covers."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _opens(c: str) -> bool:
    """Whether composition never joins this character to one before it."""
    return not unicodedata.combining(c) and unicodedata.category(c)[0] != "M" and not "ᅠ" <= c <= "ᇿ"


def cuts(text: str, codec: Codec, leaf: int = LEAF) -> list[int]:
    """Where to cut a text into leaves: at a place that no composed character or special token spans."""
    spans = [m.span() for m in codec.special_at.finditer(text)] if codec.special_at else []
    out, at = [0], leaf
    while at < len(text):
        to = at
        while to < len(text) and not (_opens(text[to]) and not any(a < to < b for a, b in spans)):
            to += 1
        if to < len(text):
            out.append(to)
        at = to + leaf
    return [*out, len(text)]


def join(a: Part, b: Part, codec: Codec) -> Part:
    """The encoding of a's text followed by b's."""
    here, back = len(a.text), 8
    while True:
        i, j = max(0, len(a.ids) - back), min(len(b.ids), back)
        while i > 0 and (a.starts[i] < a.ends[i - 1] or a.starts[i] >= a.ends[i] or not _opens(a.text[a.starts[i]])):
            i -= 1  # a window begins where a token and a composed character begin
        left = int(a.starts[i]) if i else 0
        right = int(b.ends[j - 1]) if j < len(b.ids) else len(b.text)
        while right < len(b.text) and not _opens(b.text[right]):
            right += 1
        w = codec.part(a.text[left:] + b.text[:right])
        agree = i == 0 or len(w.ids) > 1 and w.ids[0] == a.ids[i] and w.starts[0] == 0 and w.ends[0] == a.ends[i] - left and a.ends[i] <= here - REACH
        if agree and right == len(b.text):
            return _spliced(a, b, w, i, left, len(w.ids), len(b.ids))
        if agree:
            seen = {(int(s), int(e), int(x)): q for q, (s, e, x) in enumerate(zip(b.starts[:j], b.ends[:j], b.ids[:j], strict=True))}
            for m in range(len(w.ids) - 1):
                s, e = int(w.starts[m]) + left - here, int(w.ends[m]) + left - here
                if s >= 0 and e > s and e <= right - REACH and (m == 0 or w.ends[m - 1] <= w.starts[m]) and (q := seen.get((s, e, int(w.ids[m])))) is not None and (q == 0 or b.ends[q - 1] <= s):
                    return _spliced(a, b, w, i, left, m, q)
        back *= 2


def _spliced(a: Part, b: Part, w: Part, i: int, left: int, m: int, q: int) -> Part:
    """Tokens of a before i, of the window before m, of b from q."""
    here = len(a.text)
    return Part(a.text + b.text, np.concatenate([a.ids[:i], w.ids[:m], b.ids[q:]]), np.concatenate([a.starts[:i], w.starts[:m] + left, b.starts[q:] + here]), np.concatenate([a.ends[:i], w.ends[:m] + left, b.ends[q:] + here]))


def tree(parts: list[Part], codec: Codec) -> Part:
    """Joins neighbours, level by level."""
    while len(parts) > 1:
        parts = [join(parts[k], parts[k + 1], codec) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


_PART = "key string, at int, text string, ids binary, starts binary, ends binary"


def _leaves(path: str, leaf: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for pdf in batches:
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                at = cuts(text, codec, leaf)
                yield pd.DataFrame({"key": key, "at": range(len(at) - 1), "text": [text[a:b] for a, b in zip(at, at[1:], strict=False)]})

    return run


def _encoded(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    @tidied
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = codec_of(path)
        for pdf in batches:
            for at in range(0, len(pdf), LEAVES_AT_ONCE):
                some = pdf.iloc[at : at + LEAVES_AT_ONCE]
                got = [codec.part(t) for t in some["text"]]
                yield some.assign(**{k: [getattr(p, k).astype("<i4").tobytes() for p in got] for k in ("ids", "starts", "ends")})

    return run


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def long_texts(texts: DataFrame, path: str, leaf: int = LEAF, digests: bool = False) -> DataFrame:
    """Rows (key, ids array<int>) for `texts(key, text)`, one for each key, by tree concatenation. digests: in place of
    the ids their number and the digests of them and of the decoded text."""
    leaves = texts.mapInPandas(_leaves(path, leaf), "key string, at int, text string")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, so that small leaves, slow to encode, stay spread
    parts = leaves.repartition(n, "key", "at").mapInPandas(_encoded(path), _PART)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        codec, key = codec_of(path), pdf["key"].iloc[0]
        of = lambda x: np.frombuffer(x, dtype="<i4").astype(np.int64)
        ids = tree([Part(r.text, of(r.ids), of(r.starts), of(r.ends)) for r in pdf.itertuples()], codec).ids
        if not digests:
            return pd.DataFrame({"key": [key], "ids": [ids.astype(np.int32)]})
        ids = ids.tolist()
        return pd.DataFrame([(key, len(ids), _sha(" ".join(map(str, ids))), _sha(codec.tok.decode(ids, skip_special_tokens=False)))])

    return parts.groupBy("key").applyInPandas(whole, f"key string, {DIGESTS if digests else 'ids array<int>'}")


def _short(column: str, path: str, kind: str):
    out = "array<int>" if kind == "ids" else DIGESTS
    if kind == "ids":

        @tidied
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = codec_of(path)
            for s in batches:
                yield pd.Series([np.array(e.ids, dtype=np.int32) for e in codec.tok.encode_batch([t or "" for t in s], add_special_tokens=False)])
    else:

        @tidied
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = codec_of(path)
            for s in batches:
                yield pd.DataFrame([codec.digests(t or "") for t in s], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(run, out)(F.col(f"`{column}`"))


def _encode(df: DataFrame, path: str | None, column: str, leaf: int, kind: str, got: str) -> DataFrame:
    """Adds what is asked for of each text as the column `got`."""
    path = path or default_path()
    key, of = free(df, "_key"), free(df, "_of")
    text = F.col(f"`{column}`")
    long = F.coalesce(F.char_length(text), F.lit(0)) > leaf
    near = df.where(~long).withColumn(got, _short(column, path, kind))
    keyed = df.where(long).withColumn(key, F.sha2(text.cast("binary"), 256))
    texts = keyed.groupBy(F.col(key).alias("key")).agg(F.min(text).alias("text"))
    found = F.col("ids") if kind == "ids" else F.struct("n_tokens", "ids_sha256", "decoded_sha256")
    told = long_texts(texts, path, leaf, kind != "ids").select(F.col("key").alias(of), found.alias(got))
    return near.unionByName(keyed.join(told, F.col(key) == F.col(of)).drop(key, of))


def encode(df: DataFrame, path: str | None = None, column: str = "text", out: str = "ids", leaf: int = LEAF) -> DataFrame:
    """Adds the ids (array<int>) of each text, in place of a column of that name. Null and empty texts have none; other
    columns stay, whatever their names, and equal rows have equal ids."""
    return _encode(df.drop(out), path, column, leaf, "ids", out)


def decode(df: DataFrame, path: str | None = None, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids, special tokens included; a null array gives the empty text."""
    path = path or default_path()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load(path)
        for s in batches:
            yield pd.Series(tok.decode_batch([[] if x is None else list(map(int, x)) for x in s], skip_special_tokens=False), dtype=object)

    return df.withColumn(out, run(F.col(column)))


def with_digests(df: DataFrame, path: str | None = None, column: str = "text", leaf: int = LEAF) -> DataFrame:
    """Adds n_tokens and the SHA-256 of the ids and of the decoded text, without shipping the ids. A null text has
    those of an empty one. Columns of these names are replaced, others stay."""
    df = df.drop("n_tokens", "ids_sha256", "decoded_sha256")
    got = free(df, "_got")
    return _encode(df, path, column, leaf, "digests", got).select("*", f"{got}.*").drop(got)
