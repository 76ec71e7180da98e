"""Repeated passages against all pairs of paragraphs in plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from skeinflow.llm import passages
from skeinflow.llm.common import passes
from skeinflow.llm.near_duplicates import jaccard


def _plain(docs):
    """Rows (doc_id, start, n, first_doc_id, n_docs, removed), by comparing every line with every other."""
    units, lines = [], {}
    for i, text in docs:
        for _, _, w in passes(pa.array([text], pa.string())):
            a, z, is_line = passages._spans(w, w.hashes())
            words = (text or "").split()
            for x, y, line in zip(a.tolist(), z.tolist(), is_line.tolist(), strict=True):
                key = tuple(words[x:y])
                units.append((i, x, y, key))
                if line:
                    lines[key] = key

    def root(k):
        while lines.get(k, k) != k:
            k = lines[k]
        return k

    keys = list(lines)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if jaccard(" ".join(a), " ".join(b)) >= passages.SIMILAR:
                lines[root(a)] = root(b)
    own = defaultdict(list)
    for i, x, y, key in units:
        own[root(key)].append(i)
    out, by_doc = set(), defaultdict(list)
    for i, x, y, key in units:
        if len(set(own[root(key)])) > 1:
            by_doc[i].append((x, y, root(key)))
    for i, found in by_doc.items():
        runs, end = [], 0
        for x, y, k in sorted(found):
            if not runs or x > end + passages.GAP:
                runs.append([])
            runs[-1].append((x, y, k))
            end = max(end, y)
        for run in runs:
            if len({w for x, y, _ in run for w in range(x, y)}) >= passages.RUN:
                out |= {(i, x, y - x, min(own[k]), len(own[k]), i != min(own[k])) for x, y, k in run}
    return out


def test_against_all_pairs(spark):
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    lines = [say(20 + rng.randrange(40)) for _ in range(12)]
    sentences = [[*say(5 + rng.randrange(20)), "end."] for _ in range(12)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(6):
            kind = rng.randrange(6)
            if kind == 0:
                parts.append(" ".join(rng.choice(lines)))
            elif kind == 1:
                near = list(rng.choice(lines))
                near[rng.choice([0, -1])] = "other"  # one shingle of at least sixteen
                parts.append(" ".join(near))
            elif kind == 2:
                far = list(rng.choice(lines))
                for k in range(3, len(far), 6):
                    far[k] = f"x{rng.randrange(10**6)}"
                parts.append(" ".join(far))
            elif kind == 3:
                parts.append(" ".join([*say(9), *sum(rng.choices(sentences, k=3), []), *say(9)]))
            elif kind == 4:
                parts.append(" ".join([*say(7), *rng.choice(lines), *rng.choice(lines), *say(7)]))
            else:
                parts.append(" ".join(say(30)))
        docs.append((i, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "too short\nto be one")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"], r["n_docs"], r["removed"]) for r in passages.repeated(rows).collect()}
    want = _plain(docs)
    assert len(want) > 100 and got == want


def test_short_lines_that_differ_by_a_word(spark):
    """Lines of 5 to 30 words, held against all pairs of lines by their shingles, with lines and places told here."""
    rng = random.Random(5)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    blocks = [[say(n) for n in rng.choices(range(5, 31), k=8)] for _ in range(12)]
    docs = []
    for i in range(40):
        lines = []
        for _ in range(2):
            lines += [say(25), *[_edited(rng, line) for line in rng.choice(blocks)], say(25)]
        docs.append((i, "\n".join(" ".join(line) for line in lines)))
    docs += [(50 + d, "\n".join(f"{d}x{k} " + " ".join(f"t{k}w{j}" for j in range(18)) for k in range(6))) for d in range(2)]  # six lines of 19 words whose first differs
    shingles = lambda line: {tuple(line[k : k + 5]) for k in range(len(line) - 4)}
    places, roots = [], {}
    for i, text in docs:
        at = 0
        for line in (x.split() for x in text.split("\n")):
            places.append((i, at, len(line), tuple(line)))
            at += len(line)
            roots[tuple(line)] = tuple(line)

    def root(k):
        while roots[k] != k:
            k = roots[k]
        return k

    lines = [(k, shingles(k)) for k in roots]
    for n, (a, x) in enumerate(lines):
        for b, y in lines[:n]:
            if len(x & y) >= 0.8 * len(x | y):
                roots[root(a)] = root(b)
    held = defaultdict(set)
    for i, _, _, k in places:
        held[root(k)].add(i)
    want, by_doc = set(), defaultdict(list)
    for i, at, n, k in places:
        if len(held[root(k)]) > 1:
            by_doc[i].append((at, n, root(k)))
    for i, own in by_doc.items():
        runs, end = [], None
        for at, n, k in own:
            if end is None or at > end + passages.GAP:
                runs.append([])
            runs[-1].append((at, n, k))
            end = at + n
        want |= {(i, at, n, i != min(held[k])) for run in runs if sum(n for _, n, _ in run) >= passages.RUN for at, n, k in run}
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = passages.repeated(rows).collect()
    got = {(r["doc_id"], r["start_word"], r["n_words"], r["removed"]) for r in found}
    short = {(i, at, n) for i, at, n, _ in want if n < 20}
    missed = want - got
    assert len(short) > 150 and len(missed) <= 0.01 * len(want), missed  # the bands' recall at 0.8
    assert sum(r["doc_id"] >= 50 for r in found) == 12
    covered = {(i, w) for i, at, n, _ in want for w in range(at, at + n)}
    words = {i: text.split() for i, text in docs}
    for r in found:  # what is not in such lines stands in another document word by word
        i, a, z = r["doc_id"], r["start_word"], r["start_word"] + r["n_words"]
        told = f" {' '.join(words[i][a:z])} "
        assert all((i, w) in covered for w in range(a, z)) or any(told in f" {' '.join(w)} " for j, w in words.items() if j != i)


def _edited(rng, line):
    """A line with one word changed at an edge, put before it or behind it, or left out there, or as it is."""
    kind, other = rng.randrange(6), f"e{rng.randrange(10**6)}"
    return [[other, *line[1:]], [*line[:-1], other], [other, *line], [*line, other], line[1:] if len(line) > 5 else line, line][kind]


def test_cuts_by_content_of_several_stretches():
    """All stretches at once, held against one after another in plain Python."""
    rng = np.random.default_rng(8)
    h = np.concatenate([rng.integers(0, 2**63, 1500), np.full(700, 5), rng.integers(0, 3, 800)]).astype(np.uint64)
    a, z = np.array([0, 41, 90, 900, 1450, 2300]), np.array([41, 85, 900, 1400, 2300, 3000])
    want = set()
    for lo, hi in zip(a.tolist(), z.tolist(), strict=True):
        with np.errstate(over="ignore"):
            g = passages.mix(h[lo : hi - 2] + h[lo + 1 : hi - 1] * np.uint64(3) + h[lo + 2 : hi] * np.uint64(5)).tolist()
        last = lo
        for c in [*(lo + i for i, x in enumerate(g) if all(x < y for y in g[max(0, i - 4) : i] + g[i + 1 : i + 5])), hi]:
            while c - last > passages.LONGEST:
                last += passages.LONGEST
                want.add(last)
            if last < c < hi:
                want.add(c)
                last = c
    got = passages._content_cuts(h, a, z)
    assert set(got.tolist()) == want | set(a.tolist()) and len(want) > 100
    assert len(passages._content_cuts(h, a[:0], z[:0])) == 0
