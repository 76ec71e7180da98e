"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Each rule scores a document; a score over the rule's cutoff rejects it. For each stratum (language) and rule,
labelled good documents are the holdout: cutoffs of a fixed grid are tried from the mildest to the strictest,
and each is kept while an exact binomial test shows, at the corrected level, that the rule rejects at most its
share of good documents. The first failure ends the sequence, which needs no correction over cutoffs
(fixed-sequence testing); strata and rules share the error level equally (Bonferroni), and rules share the
risk, so that all rules together reject at most RISK of a stratum's good documents that pass the base checks, with
confidence 1 - ERROR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, free

RISK, ERROR = 0.05, 0.05
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SPACE = r"[\x20\x09-\x0D]"
#: Rules and their cutoffs, mildest first. Scores are shares of the document's words.
RULES = {
    "symbols": ("n_symbols / n_words", [2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.03]),
    "dup_lines": ("n_dup_lines / n_words", [0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]),
    "repeats": ("n_repeat_words / n_words", [0.29, 0.27, 0.25, 0.22, 0.2, 0.17, 0.15, 0.12, 0.1, 0.08, 0.05]),
}


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in runs of WINDOW words that stand twice or more in the text."""
    n = F.size(words)

    def covered(runs: Column) -> Column:
        def of(s: Column) -> Column:
            again = F.transform(s, lambda x, i: F.struct(x["p"].alias("p"), F.coalesce((x["h"] == F.get(s, i - 1)["h"]) & (i > 0), F.lit(False)).alias("a"), F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)).alias("b")))
            at = F.array_sort(F.transform(F.filter(again, lambda y: y["a"] | y["b"]), lambda y: y["p"]))
            start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(at, start, lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.cast("int").alias("last")))["n"]

        return _let(F.array_sort(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.cast("int").alias("p")))), of)

    def runs(ws: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ws) - WINDOW + 1), lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    counted = _let(runs(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)))
    return F.when(n >= 2 * WINDOW - (WINDOW - 1), counted).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to `docs(text, ...)`.
    A null text has no words. Runs of words are compared by a 64-bit hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(split, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    made = free(docs, "_w")
    got = docs.withColumn(made, counted).withColumns(
        {
            "n_words": F.col(f"{made}.n"),
            "word_chars": F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long"),
            "n_symbols": (F.char_length(text) - F.char_length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
            "n_repeat_words": F.col(f"{made}.r"),
        }
    )
    return got.drop(made).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _log_factorial(n: Column) -> Column:
    """ln n!: exact to double precision up to 20, by Stirling's series beyond (error under 1e-12)."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p) with k <= n p: the point probability at k, and those below by their
    ratios; terms further down than ten standard deviations and fifty are under 1e-20 of the sum."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    steps = F.least(k.cast("int"), (10 * F.sqrt(n.cast("double")) + 50).cast("int"))
    odds = (1 - p) / p
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def down(acc: Column, j: Column) -> Column:
        term = acc["term"] * (k - j + 1) / (n - k + j) * odds
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    below = F.when(steps > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), start, down)["sum"]).otherwise(F.lit(1.0))
    return F.exp(top) * below


def cutoffs(good: DataFrame, stratum: str = "stratum", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """For each stratum of `good` (measures of labelled good documents that pass the base checks) the cutoff
    of each rule, null where the evidence carries none. One row for each stratum, named by its rule."""
    each = risk / len(RULES)
    grid = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff")) for r, (_, cs) in RULES.items() for i, c in enumerate(cs)])
    counts = [F.sum(F.when(F.expr(score) > c, 1).otherwise(0)).alias(f"{r}_{i}") for r, (score, cs) in RULES.items() for i, c in enumerate(cs)]
    by = good.groupBy(stratum).agg(F.count("*").alias("n"), *counts)
    cells = by.select(stratum, "n", F.explode(grid).alias("g"), F.create_map(*[x for r, (_, cs) in RULES.items() for i in range(len(cs)) for x in (F.lit(f"{r}_{i}"), F.col(f"{r}_{i}"))]).alias("over")).select(stratum, "n", "g.*", F.col("over")[F.concat_ws("_", "g.rule", F.col("g.step").cast("string"))].alias("k"))
    level = F.lit(error / len(RULES)) / F.col("strata")
    strata = by.agg(F.greatest(F.count("*"), F.lit(1)).alias("strata"))
    tested = cells.join(F.broadcast(strata), F.lit(True))  # one row
    passed = F.when(F.col("k") > F.col("n") * each, False).otherwise(binomial_cdf(F.col("k"), F.col("n"), each) <= level)
    first = tested.withColumn("ok", passed).groupBy(stratum, "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.collect_list(F.struct("step", "cutoff")).alias("steps"))
    last = first.select(stratum, "rule", F.expr("array_max(filter(steps, s -> stop is null or s.step < stop)).cutoff").alias("cutoff"))
    return last.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(r) for r in RULES])


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: Column | None = None, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """`docs` (doc_id, text, ...) without their texts, with the measures, base_failed, rule (the first that rejects,
    else null) and kept; columns of these names are replaced, others stay. Of a stratum's good documents that pass the
    base checks a limited share is rejected. Good documents are those whose labels all have quality 1; a null
    stratum is one of its own. Documents of a stratum without a cutoff are kept by the rules, and so are all without
    labels. A null or empty text fails the base checks; equal rows are judged alike."""
    docs = docs.drop("rule", "kept")
    own, of, limit = (free(docs, c) for c in ("stratum", "_s", "_limits"))
    stratum = F.coalesce(F.col("lang") if stratum is None else stratum, F.lit(""))
    rows = checkpoint(measures(docs.withColumn(own, stratum)).drop("text"))
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    found = cutoffs(rows.where("not base_failed").join(good, "doc_id", "left_semi"), own, risk, error)
    limits = found.select(F.col(own).alias(of), F.struct(*RULES).alias(limit))
    rule = F.when(F.col("base_failed"), F.lit("base"))
    for r, (score, _) in RULES.items():
        rule = rule.when(F.col("n_words").isNotNull() & (F.expr(f"if(n_words = 0, 0D, {score})") > F.col(f"{limit}.{r}")), F.lit(r))
    got = rows.join(limits, F.col(own) == F.col(of), "left").withColumn("rule", rule)
    return got.withColumn("kept", F.col("rule").isNull()).drop(own, of, limit)


def _sql() -> str:
    each = RISK / len(RULES)
    cells = " union all ".join(f"select lang, n_words, '{r}' as rule, {i} as step, {c!r}::double as cutoff, ({score.replace(' / ', '::double / ')}) > {c!r} as hit from good" for r, (score, cs) in RULES.items() for i, c in enumerate(cs))
    rules = " ".join(f"when {score.replace(' / ', '::double / ')} > l_{r} then '{r}'" for r, (score, _) in RULES.items())
    limits = ", ".join(f"max(case when rule = '{r}' then cutoff end) as l_{r}" for r in RULES)
    return rf"""
with w as (
  select doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    row_number() over () as rid
  from documents),
g as (select rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') as run
  from (select rid, words, unnest(range(1, len(words) - {WINDOW} + 2)) as i from w where len(words) >= {WINDOW})),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, run) as n from g) where n > 1),
covered as (select rid, count(distinct i + j) as n from again, (select unnest(range(0, {WINDOW})) as j) group by rid),
m as (
  select doc_id, lang, len(words)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words
  from w left join covered using (rid)),
f as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from m),
good as (select * from f where not base_failed and doc_id in (select doc_id from labels group by doc_id having min(quality) = 1)),
cells as ({cells}),
k as (select lang, rule, step, cutoff, count(*) as n, count(*) filter (hit) as k from cells group by all),
t as (select *, k <= n * {each!r} and (
    select sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({each!r}) + (n - j) * ln(1 - {each!r})))
    from (select unnest(range(0, k + 1)) as j)) <= {ERROR!r} / {len(RULES)} / (select count(distinct lang) from good) as ok from k),
s as (select lang, rule, min(case when not ok then step end) as stop from t group by all),
l as (select lang, rule, arg_max(cutoff, step) as cutoff from t join s using (lang, rule) where stop is null or step < stop group by all),
limits as (select lang, {limits} from l group by lang),
r as (select f.*, case when base_failed then 'base' {rules} end as rule from f left join limits using (lang))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule is null as kept, rule from r
"""


SQL = _sql()
