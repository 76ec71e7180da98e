"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model gives each document evidence for being junk and for being toxic. Hosts and the paths below
them have rates of their own: a host's rate is drawn towards the global rate, a path's towards its host's,
each by a strength that the spread between hosts, and between paths of a host, supports (method of moments
of the beta-binomial), so sparse sites stay near the rates above them. A document's posterior joins its own
evidence with the rate of its path without it."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import brief as small, checkpoint, free, tidied

#: Most labelled documents that the model is fitted on, those of the smallest hash, and most words for each target.
FIT_ROWS, FIT_WORDS = 8_000, 200
#: Words of a block, within which the variety of a text's words is taken.
BLOCK = 200
#: A word must stand in so many of them, and its chi-square must be so large.
LEAST_DOCS, LEAST_CHI2 = 5, 25.0
TARGETS = ("junk", "toxic")
REJECT_FROM = 0.5
ADDED = ("junk_probability", "toxic_probability", "rejected")
#: Bounds of the strength of a prior, in documents.
STRENGTH = (1.0, 10_000.0)
SHAPE = ("log_words", "word_length", "symbols", "upper", "digits", "bars", "variety", "repeats", "line_words", "stops", "marks")
WORD = re.compile(r"[^\W\d_]+")


#: All bytes of ASCII but letters, as spaces.
SPACED = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def variety(words: list[str]) -> float:
    """The mean share of distinct words over all blocks of BLOCK words, the last one reaching back; a text
    of fewer words is one block."""
    n = len(words)
    if n <= BLOCK:
        return len(set(words)) / max(1, n)
    starts = [*range(0, n - BLOCK, BLOCK), n - BLOCK]
    return sum(len(set(words[i : i + BLOCK])) for i in starts) / (BLOCK * len(starts))


def shape(text: str) -> list[float]:
    """Figures of a text's form, all bounded."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    alone = sum(map(words.count, ("|", "-", "*", "#")))
    same = sum(map(operator.eq, words, words[1:]))
    symbols = sum(map(text.count, "#*$%&|<>{}@^~=_\\"))
    marks = sum(map(text.count, "!?"))
    upper = sum(len(w) > 1 for w in filter(str.isupper, words))
    digits = sum(map(text.count, "0123456789"))
    return [np.log1p(len(words)), min(20.0, sum(map(len, words)) / n), min(2.0, symbols / n), upper / n, min(1.0, 5 * digits / chars), alone / n, variety(words), same / n, np.log1p(len(words) / max(1, len(lines))), sum(w.endswith((".", ",")) for w in words) / n, min(2.0, marks / n)]


def tokens(text: str) -> set[str]:
    """The distinct words: runs of letters, in lower case."""
    pieces = set(text.lower().encode("utf-8", "surrogatepass").translate(SPACED).decode("utf-8", "surrogatepass").split())
    plain = set(filter(str.isascii, pieces))
    return plain.union(*map(WORD.findall, pieces - plain))


def worst(labels: DataFrame) -> DataFrame:
    """One row for each labelled id: junk (quality 0) and toxic, 0 or 1. Of several labels the worst counts; null
    ids and null labels say nothing."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("double").alias("junk"), F.max("toxic").cast("double").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (text, junk, toxic) of at most FIT_ROWS labelled documents, those whose ids have the smallest hash.

    They are chosen among ids alone, and their texts are then found by a broadcast of so few ids, so texts of other
    documents are never shuffled. Of several texts of an id the least one is taken."""
    both = worst(labels).where("junk is not null and toxic is not null")
    chosen = both.join(docs.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.join(F.broadcast(checkpoint(chosen)), "doc_id").groupBy("doc_id", "junk", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return texts.select("text", "junk", "toxic")


@dataclass
class Model:
    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # a row for each target
    base: np.ndarray  # log odds among the labelled

    def features(self, texts: Iterator[str | None]) -> np.ndarray:
        rows = [shape(t or "") for t in texts]
        return (np.array(rows, dtype=float).reshape(-1, len(SHAPE)) - self.mean) / self.scale

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """Log likelihood ratios of each target for each text."""
        k = len(SHAPE)
        out = self.features(texts) @ self.weights[:, 1 : k + 1].T + self.weights[:, 0] - self.base
        for i, t in enumerate(texts):
            if hit := sorted(self.words[w] for w in self.words.keys() & tokens(t or "")):
                out[i] += self.weights[:, k + 1 :][:, hit].sum(axis=1)
        return np.clip(out, -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.3, steps: int = 60) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the first column is the constant."""
    w, lam = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    lam[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * r[:, None]).T @ x + np.diag(lam), x.T @ (p - y) + lam * w)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(known: DataFrame) -> Model:
    """The model of `known(text, junk, toxic)`, at most FIT_ROWS rows. Without labels of both kinds a target has
    no evidence."""
    rows = checkpoint(known)
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))
    total = rows.agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    n = total["n"]
    chosen: dict[str, int] = {}
    if n:
        seen = rows.select(F.explode(words).alias("w"), *TARGETS).groupBy("w").agg(F.count("*").alias("df"), *[F.sum(t).alias(t) for t in TARGETS]).where(F.col("df") >= LEAST_DOCS)
        for t in TARGETS:
            want = F.col("df") * F.lit(float(total[t]) / n)
            rest = F.greatest(want * F.lit(1 - float(total[t]) / n) * (1 - F.col("df") / n), F.lit(1e-9))
            chi2 = (F.col(t) - want) * (F.col(t) - want) / rest
            for r in seen.select("w", chi2.alias("x")).where(F.col("x") >= LEAST_CHI2).orderBy(F.desc("x"), "w").limit(FIT_WORDS).collect():
                chosen.setdefault(r["w"], len(chosen))
    k = len(SHAPE)

    @F.pandas_udf("array<double>")
    def features(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            x = np.zeros(k + len(chosen))
            x[:k] = shape(t or "")
            x[[k + chosen[w] for w in chosen.keys() & tokens(t or "")]] = 1
            out.append(x)
        return pd.Series(out)

    got = rows.select(features("text").alias("x"), *TARGETS).toPandas()  # at most FIT_ROWS rows of numbers
    x = np.array(got["x"].tolist(), dtype=float).reshape(-1, k + len(chosen))
    mean, scale = (x[:, :k].mean(axis=0), x[:, :k].std(axis=0)) if n else (np.zeros(k), np.ones(k))
    scale[scale < 1e-9] = 1
    weights, base = np.zeros((len(TARGETS), 1 + k + len(chosen))), np.zeros(len(TARGETS))
    if n:
        x[:, :k] = (x[:, :k] - mean) / scale
        x = np.hstack([np.ones((len(x), 1)), x])
        for i, t in enumerate(TARGETS):
            y = got[t].to_numpy(dtype=float)
            if 0 < y.sum() < len(y):
                weights[i] = _logistic(x, y)
                base[i] = np.log(y.sum() / (len(y) - y.sum()))
    return Model(chosen, mean, scale, weights, base)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, of: Column, out: str) -> DataFrame:
    """One row: the prior strength, in documents, that the spread of groups' rates around `of` supports."""
    rate = F.col(s) / F.col(n)
    apart = F.sum(F.col(n) * (rate - of) * (rate - of))
    inside = F.sum(of * (1 - of))
    least = F.sum(F.col(n) * of * (1 - of))
    between = F.greatest((apart - inside) / F.greatest(least - inside, F.lit(1e-9)), F.lit(1e-9))
    return groups.agg(F.coalesce(F.least(F.greatest(1 / between - 1, F.lit(STRENGTH[0])), F.lit(STRENGTH[1])), F.lit(STRENGTH[1])).alias(out))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds junk_probability, toxic_probability (double) and rejected (boolean) to `docs`.

    keep: the columns of `docs` to return, by default all. Name those needed where the texts aren't: otherwise the
    judgements are joined back to the texts.

    host: by default the source; path: by default the language section of the source. Null hosts and paths
    are sites of their own; a null text has the evidence of an empty one. Equal rows are judged alike, each has its
    row. Known labels count in place of evidence in a site's rate, but a document's own label has no part in its
    own posterior. Without documents, or without labels of both kinds, nothing is rejected. Added columns replace
    columns of these names."""
    if keep is None:
        id_, key, row = (free(docs, c) for c in ("_id", "_key", "_row"))
        own = docs.withColumns(_row_key(docs, id_, key))
        fresh = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
        judged = checkpoint(classify(own, labels, host, path, [id_, key]).dropDuplicates([id_, key]))
        return own.select(id_, key, F.struct(*fresh).alias(row)).join(judged, [id_, key]).select(f"{row}.*", *ADDED)
    host = F.coalesce(F.col("source") if host is None else host, F.lit(""))
    path = F.coalesce(F.col("lang") if path is None else path, F.lit(""))
    model = fit(labelled(docs.select("doc_id", "text"), labels))

    @tidied
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(model.evidence(list(s)), columns=list(TARGETS))

    @F.pandas_udf("junk double, toxic double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from weighed(batches)

    fresh = [F.col(f"`{c}`") for c in keep if c not in ADDED]
    scored = checkpoint(docs.select("doc_id", F.struct(*fresh).alias("_row") if fresh else F.lit(None).alias("_row"), host.alias("_host"), path.alias("_path"), evidence("text").alias("_e")))
    known = worst(labels).select(F.col("doc_id").alias("_id"), *[F.col(t).alias(f"_{t}") for t in TARGETS])
    p = {t: 1 / (1 + F.exp(-(F.col(f"_e.{t}") + F.lit(float(model.base[i]))))) for i, t in enumerate(TARGETS)}
    # What a document adds to the sums of its site: its label, else its probability.
    scored = scored.join(known, F.col("doc_id") == F.col("_id"), "left").select("_row", "_host", "_path", "_e", *[F.coalesce(f"_{t}", p[t]).alias(f"_{t}") for t in TARGETS])
    sites = checkpoint(scored.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"_{t}").alias(t) for t in TARGETS]))
    hosts = sites.groupBy("_host").agg(F.sum("n").alias("hn"), *[F.sum(t).alias(f"h_{t}") for t in TARGETS])
    rates = checkpoint(sites.join(hosts, "_host"))
    total = hosts.agg(F.sum("hn").alias("n"), *[F.sum(f"h_{t}").alias(t) for t in TARGETS]).first()
    strong, of = {}, {}
    for t in TARGETS:
        of[t] = float(total[t]) / total["n"] if total["n"] else 0.0
        strong[t] = (float(_strength(hosts, "hn", f"h_{t}", F.lit(of[t]), "x").first()[0]), float(_strength(rates, "n", t, F.col(f"h_{t}") / F.col("hn"), "x").first()[0]))
    back = scored.join(small(rates).withColumnsRenamed({"_host": "_rh", "_path": "_rp"}), (F.col("_host") == F.col("_rh")) & (F.col("_path") == F.col("_rp")))
    out = {}
    for i, t in enumerate(TARGETS):
        up, low = strong[t]
        at_host = (F.col(f"h_{t}") - F.col(f"_{t}") + up * of[t]) / (F.col("hn") - 1 + up)
        at_path = (F.col(t) - F.col(f"_{t}") + low * at_host) / (F.col("n") - 1 + low)
        out[f"{t}_probability"] = 1 / (1 + F.exp(-(F.col(f"_e.{t}") + _logit(at_path)))) if model.weights[i].any() else F.lit(0.0)
    got = back.withColumns(out).withColumn("rejected", (F.col("junk_probability") >= REJECT_FROM) | (F.col("toxic_probability") >= REJECT_FROM))
    return got.select(*["_row.*"] * bool(fresh), *ADDED)


def _row_key(docs: DataFrame, id_: str, key: str) -> dict[str, Column]:
    """A row's id as text, and a hash of the whole row."""
    return {id_: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key: F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])}


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """`docs` without those that `classify` rejects. Evidence is taken once, who goes is settled without the texts,
    and these are shuffled only where too many go for a broadcast."""
    id_, key = free(docs, "_id"), free(docs, "_key")
    own = docs.withColumns(_row_key(docs, id_, key))
    go = checkpoint(classify(own, labels, keep=[id_, key], **how).where("rejected").select(id_, key).distinct())
    return own.join(small(go), [id_, key], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
