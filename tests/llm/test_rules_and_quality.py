"""Quality rules against plain counts and SQL; the classifier on held-out labels."""

import math
import random
import re

from pyspark.sql import functions as F

from skeinflow.llm import queries, quality_model, quality_rules

from ..conftest import SF
from ..oracle import connect, same

SPACE = r"[\x20\x09-\x0D]+"


def _plain(text):
    text = text or ""
    words = [w for w in re.split(SPACE, text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed


def test_measures(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a", "one two\none two\n \none two", "x " * 30, "É\x0bü\x0c# | z", "w " * 7, "w " * 8, "w " * 9]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += ["\n".join(rng.choice(["l1 x", "l2 $", "", "l3"]) for _ in range(20)) for _ in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: tuple(r)[2:] for r in quality_rules.measures(rows).collect()}
    assert got == {i: _plain(t) for i, t in enumerate(texts)}


def test_binomial(spark):
    cases = [(0, 10, 0.1), (3, 50, 0.05), (25, 1000, 0.02), (0, 400, 0.0167), (15, 15, 0.5)]
    for k, n, p in cases:
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        if k <= n * p:
            assert abs(got - want) < 1e-9 * max(1, want)


def test_false_rejections_are_few(spark):
    """Cutoffs from one half of good documents reject few of the other half."""
    rng = random.Random(2)
    good = [(i, "en" if i % 2 else "de", 100, int(rng.expovariate(0.5)), 0, int(rng.expovariate(0.2))) for i in range(8000)]
    rows = spark.createDataFrame(good, "doc_id long, stratum string, n_words long, n_symbols long, n_dup_lines long, n_repeat_words long")
    cut = {r["stratum"]: r for r in quality_rules.cutoffs(rows.where("doc_id < 4000")).collect()}
    assert set(cut) == {"en", "de"} and all(r["symbols"] is not None for r in cut.values())
    for lang, r in cut.items():
        rest = [x for x in good if x[0] >= 4000 and x[1] == lang]
        out = sum(any(v is not None and x[k] / 100 > v for k, v in ((3, r["symbols"]), (4, r["dup_lines"]), (5, r["repeats"]))) for x in rest)
        assert out <= quality_rules.RISK * len(rest)


def test_few_labels_reject_nothing(spark):
    docs = spark.createDataFrame([(1, "en", " ".join(f"{i} $" for i in range(40))), (2, None, None), (2, None, None), (None, "en", "a")], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.apply_rules(docs, labels)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in got.collect()) == [("1", True), ("2", False), ("2", False), ("None", False)]
    assert quality_rules.apply_rules(docs.limit(0), labels).count() == 0


def test_sql(spark):
    same(queries.op6_controlled_rules(spark, SF), connect(SF), queries.oracle_sql()["op6_controlled_rules"])


def _corpus(spark, n=600):
    rng = random.Random(4)
    fine, bad = [f"good{i}" for i in range(60)], [f"hate{i}" for i in range(6)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 10 == 0, i % 7 == 0
        words = rng.choices(fine, k=40) + (rng.choices(bad, k=6) if toxic else []) + (["|", "#", "|"] * 20 if junk else [])
        rng.shuffle(words)
        docs.append((i, " ".join(words) + ".", f"site{i % 5}", "en"))
        labels.append((i, 0 if junk else 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), labels


def test_held_out(spark):
    docs, labels = _corpus(spark)
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["rejected"] for r in quality_model.classify(docs, known).collect()}
    held = [x for x in labels if x[0] >= 400]
    right = sum(got[i] == (q == 0 or t == 1) for i, q, t in held)
    assert right / len(held) > 0.95


def test_variety_is_of_the_whole_text():
    at = quality_model.SHAPE.index("variety")
    of = lambda words: quality_model.shape(" ".join(words))[at]
    varied, same = [f"v{i}" for i in range(200)], [f"s{i % 7}" for i in range(3000)]
    assert of(varied) == 1 and of([f"v{i}" for i in range(3100)]) == 1
    assert of(varied + same) < 0.15 and of(same + varied) < 0.15  # one block in 16 is varied
    assert of(varied + ["s"]) == 1 and of(varied + ["s"] * 100) == (1 + 101 / 200) / 2
    assert of([]) == 0 and of(["a", "a"]) == 0.5


def test_lone_site(spark):
    """A site of one document is judged by the document and the rates above."""
    docs, labels = _corpus(spark)
    alone = docs.where("doc_id = 400").withColumn("source", F.lit("alone"))
    known = spark.createDataFrame([x for x in labels if x[0] < 400], "doc_id long, quality int, toxic int")
    got = quality_model.classify(docs.where("doc_id <> 400").unionByName(alone), known).where("source = 'alone'").first()
    assert 0 <= got["toxic_probability"] <= 1 and got["rejected"]


def _plain_posteriors(rows, known, model):
    """The posteriors of rows (doc_id, text, host, path), by the formulas, one document at a time."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    clip = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    evidence = model.evidence([r[1] for r in rows])
    out = [[] for _ in rows]
    for k in range(2):
        adds = [known.get(r[0], (None, None))[k] for r in rows]
        adds = [sig(e[k] + model.base[k]) if a is None else a for a, e in zip(adds, evidence, strict=True)]
        hosts, paths = {}, {}
        for r, a in zip(rows, adds, strict=True):
            for at, i in ((hosts, r[2]), (paths, r[2:4])):
                n, s = at.get(i, (0, 0))
                at[i] = n + 1, s + a
        of = sum(s for _, s in hosts.values()) / len(rows)

        def strength(groups):
            apart = sum(n * (s / n - m) ** 2 for n, s, m in groups)
            inside, least = sum(m * (1 - m) for _, _, m in groups), sum(n * m * (1 - m) for n, _, m in groups)
            between = max((apart - inside) / max(least - inside, 1e-9), 1e-9)
            return min(max(1 / between - 1, quality_model.STRENGTH[0]), quality_model.STRENGTH[1])

        up = strength([(n, s, of) for n, s in hosts.values()])
        low = strength([(n, s, hosts[i[0]][1] / hosts[i[0]][0]) for i, (n, s) in paths.items()])
        for o, r, a, e in zip(out, rows, adds, evidence, strict=True):
            (hn, hs), (n, s) = hosts[r[2]], paths[r[2:4]]
            rate = (s - a + low * (hs - a + up * of) / (hn - 1 + up)) / (n - 1 + low)
            assert 0 <= rate <= 1
            o.append(sig(e[k] + math.log(clip(rate) / (1 - clip(rate)))))
    return out


def test_posteriors(spark):
    """Against plain Python; one text alone on three sites is judged alike, whatever its own label says."""
    docs, labels = _corpus(spark)
    rows = [tuple(r) for r in docs.collect()]
    text = rows[70][1]
    rows = [(i, t, "site9" if i % 6 == 0 and i % 7 == 0 else s, "de" if i % 4 == 0 else "en") for i, t, s, _ in rows] + [(900 + i, text, f"alone{i}", "en") for i in range(3)]
    given = [x for x in labels if x[0] % 3] + [(901, 1, 0), (902, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    known = spark.createDataFrame(given, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["junk_probability"], r["toxic_probability"]) for r in quality_model.classify(docs, known).collect()}
    want = _plain_posteriors(rows, {i: (1.0 - q, float(t)) for i, q, t in given}, quality_model.fit(quality_model.labelled(docs, known)))
    for r, w in zip(rows, want, strict=True):
        assert max(abs(a - b) for a, b in zip(got[r[0]], w, strict=True)) < 1e-9
    assert got[900] == got[901] == got[902]
    kept = {r["doc_id"] for r in quality_model.keep_good(docs, known).collect()}
    assert kept == {i for i, p in got.items() if max(p) < quality_model.REJECT_FROM}


def test_odd_rows(spark):
    docs, labels = _corpus(spark, 40)
    odd = spark.createDataFrame([(None, None, None, None), (5, "", "s", "l"), (5, "", "s", "l")], "doc_id long, text string, source string, lang string").withColumn("rejected", F.lit("old"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_model.classify(odd, none)
    assert got.count() == 3 and got.where("rejected").isEmpty() and got.columns[:4] == docs.columns
    assert quality_model.classify(docs.limit(0), none).count() == quality_model.keep_good(docs.limit(0), none).count() == 0
    kept = quality_model.keep_good(odd.withColumns({c: F.lit("mine") for c in ("_id", "_key", "_row", "n", "junk", "toxic")}), none)
    assert kept.count() == 3 and kept.columns[-6:] == ["_id", "_key", "_row", "n", "junk", "toxic"]
    long = spark.createDataFrame([(1, "good1 " * 300_000, "s", "l"), (2, "x" * 10**6, "s", "l")], docs.schema)
    assert quality_model.classify(docs.unionByName(long), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == docs.count() + 2
    twice = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.classify(docs, twice).count() == docs.count()
