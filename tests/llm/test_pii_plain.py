"""Pseudonyms over a whole table against a detector of its own."""

import re
from datetime import date

from skeinflow.llm import pii
from skeinflow.llm.common import table


def _card(s):
    digits = [int(c) for c in s if c.isdigit()]
    doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


def _day(s):
    try:
        date.fromisoformat(s)
    except ValueError:
        return False
    return True


KINDS = {
    "card": (re.compile(r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"), _card),
    "date": (re.compile(r"(?<![\w/.-])\d{4}-\d\d-\d\d(?![\w/.-])"), _day),
    "ip": (re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])"), lambda s: all(int(x) < 256 for x in s.split("."))),
    "email": (re.compile(r"(?<![\w.@+-])[a-z0-9]+(?:[._][a-z0-9]+)*@[a-z0-9]+(?:[.-][a-z0-9]+)+(?![\w@-])"), lambda s: True),
}


def _found(text):
    return {k: [v for v in form.findall(text or "") if fits(v)] for k, (form, fits) in KINDS.items()}


def test_every_value_of_a_table_is_replaced(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "a key").collect()}
    assert before.keys() == after.keys()
    there, back, seen = {}, {}, dict.fromkeys(KINDS, 0)
    for i, text in before.items():
        was, now = _found(text), _found(after[i])
        if not any(was.values()):
            continue
        for kind, values in was.items():
            seen[kind] += len(values)
            assert len(now[kind]) == len(values), (i, kind)  # all are of their form still, and in their order
            for a, b in zip(values, now[kind], strict=True):
                assert there.setdefault((kind, a), b) == b and back.setdefault((kind, b), a) == a  # one for one, in all documents
                assert a != b, (i, kind, a)
        marks = re.compile("|".join(f"(?:{form.pattern})" for form, _ in KINDS.values()))
        if not re.search(r"\d{3}-\d\d-\d{4}|[A-Z]{2}\d\d|\+\d|\(\d{3}\)|\d{3}[.-]\d{3}[.-]\d{4}|[0-9a-fA-F]{32}|\d\d[/.]\d\d[/.]\d{4}|\d{4}/", text):
            assert marks.sub("", text) == marks.sub("", after[i])  # nothing else changes
    assert all(seen[k] > 3 for k in ("card", "ip", "email")), seen
