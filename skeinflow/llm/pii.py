"""Format-preserving Feistel pseudonyms for personal data in texts.

Each value is checked for its kind (Luhn digit of a card number, octets of an address, a real calendar
day), permuted by a keyed Feistel network over the numbers of its own format, and written back in that
format. Equal values have equal pseudonyms in all documents, and the key's holder can undo them."""

from __future__ import annotations

import hashlib
import hmac
import re
from calendar import monthrange
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free

ROUNDS = 10
#: First days of the ranges within which dates are permuted, so that living people's stay likely ones.
RANGES = (date.min, date(1900, 1, 1), date(2100, 1, 1))
LETTERS = "abcdefghijklmnopqrstuvwxyz"

#: One pass finds all kinds; the first alternative that fits at a place wins.
FOUND = re.compile(
    r"(?<![A-Za-z0-9._%+\-])(?P<email>(?=[._%+\-]*+[A-Za-z0-9])[A-Za-z0-9._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)+)"
    r"|(?<![\w.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?![\w]|\.\d)"
    r"|(?<![\w\-/.])(?P<date>\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w\-/]|\.\d)"
    r"|(?<![\w\-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w\-])"
    r"|(?<![\w])(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?)(?![A-Za-z0-9])"
    r"|(?<![\w])(?P<card>\d(?:[ \-]?\d){12,18})(?![\w]|-\d)"
    r"|(?<![\w+])(?P<phone>\+\d{1,3}[ .\-]?\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|\+\d{1,3}(?:[ \-]\d{2,4}){2,4}|\+\d{1,3}(?:\.\d{2,4}){2,4}|\+\d{8,15}|\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\w]|[\-.]\d)"
    r"|(?<![A-Za-z0-9])(?P<secret>[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![A-Za-z0-9])"
)
#: The kinds by themselves, in their order.
EACH = {k: re.compile(x) for x in re.split(r"\|(?=\(\?<!)", FOUND.pattern) for k in re.findall(r"\?P<(\w+)>", x)}
#: Length of an IBAN by country; in other countries any length that passes the check counts.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}


class Feistel:
    """A keyed permutation of 0 .. size - 1: a Feistel network over two near-equal halves, walked until it lands below size."""

    def __init__(self, key: str, kind: str, size: int):
        self.size = size
        self.a = max(1, int(size**0.5))
        while self.a * self.a < size:
            self.a += 1
        self.key = hashlib.sha256(f"{key}\x00{kind}\x00{size}".encode()).digest()
        self.wide = (size.bit_length() + 7) // 8 + 1

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hmac.digest(self.key, bytes([i]) + x.to_bytes(self.wide, "big"), "sha256")[:24], "big") % self.a

    def _once(self, n: int, back: bool) -> int:
        left, right = divmod(n, self.a)
        if back:
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._f(i, left)) % self.a, left
        else:
            for i in range(ROUNDS):
                left, right = right, (left + self._f(i, right)) % self.a
        return left * self.a + right

    def __call__(self, n: int, back: bool = False) -> int:
        if self.size < 2:
            return n
        n = self._once(n, back)
        while n >= self.size:
            n = self._once(n, back)
        return n


def _end(first: date) -> int:
    """The ordinal behind the last day of a range."""
    return min((x.toordinal() for x in RANGES if x > first), default=date.max.toordinal() + 1)


def _late(first: date) -> tuple[np.ndarray, int]:
    """For the months of a range: how many days after the twelfth, which no month can be, are before it; and in all."""
    return _late_counts(first.year, date.fromordinal(_end(first) - 1).year)


@lru_cache(maxsize=4)
def _late_counts(first: int, last: int) -> tuple[np.ndarray, int]:
    n = np.array([monthrange(y, m)[1] - 12 for y in range(first, last + 1) for m in range(1, 13)])
    before = np.concatenate([[0], np.cumsum(n)])
    return before[:-1], int(before[-1])


def luhn_ok(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


class Pseudonyms:
    """Permutes values within their formats under a key. back: the other way round."""

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = key, back
        self._nets = lru_cache(maxsize=4096)(lambda kind, size: Feistel(key, kind, size))
        #: By value, so that a value seen again costs nothing; bounded.
        self.of = lru_cache(maxsize=200_000)(self._of)

    def number(self, kind: str, n: int, size: int) -> int:
        return self._nets(kind, size)(n, self.back)

    def signs(self, kind: str, text: str) -> str:
        """Digits stay digits, lower and upper case letters stay so, all else stays."""
        n, size = 0, 1
        for c in text:
            r = 10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1
            if r > 1:
                n, size = n * r + (int(c) if r == 10 else LETTERS.index(c.lower())), size * r
        n, out = self.number(kind, n, size), []
        for c in reversed(text):
            if c in "0123456789":
                n, d = divmod(n, 10)
                out.append(str(d))
            elif c.isascii() and c.isalpha():
                n, d = divmod(n, 26)
                out.append(LETTERS[d].upper() if c.isupper() else LETTERS[d])
            else:
                out.append(c)
        return "".join(reversed(out))

    def _of(self, kind: str, value: str) -> str | None:
        """The value's pseudonym; None if it fails the check of its kind."""
        return getattr(self, f"_{kind}")(value)

    def _email(self, v: str) -> str:
        name, _, host = v.rpartition("@")
        return f"{self.signs('email', name)}@{host}"

    def _ip(self, v: str) -> str | None:
        parts = [int(x) for x in v.split(".")]
        if max(parts) > 255 or any(x != str(int(x)) for x in v.split(".")):
            return None
        n = self.number("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, n.to_bytes(4, "big")))

    def _date(self, v: str) -> str | None:
        """Where the month stands first, a day that can't be one says that the day does; such days are permuted among
        themselves, so that the way back reads them alike."""
        sep = next(c for c in v if not c.isdigit())
        parts = v.split(sep)
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0)] if sep == "." else [(2, 0, 1), (2, 1, 0)]
        for order in orders:
            try:
                day = date(*(int(parts[i]) for i in order))
            except ValueError:
                continue
            late = order != orders[0]
            first = max(x for x in RANGES if x <= day)
            if late:
                before, size = _late(first)
                n = self.number(f"late{first}", int(before[12 * (day.year - first.year) + day.month - 1]) + day.day - 13, size)
                month = int(np.searchsorted(before, n, side="right")) - 1
                got = date(first.year + month // 12, month % 12 + 1, n - int(before[month]) + 13)
            else:
                n = self.number(f"date{first}", day.toordinal() - first.toordinal(), _end(first) - first.toordinal())
                got = date.fromordinal(first.toordinal() + n)
            for i, x in zip(order, (f"{got.year:04}", f"{got.month:02}", f"{got.day:02}"), strict=True):
                parts[i] = x
            return sep.join(parts)
        return None

    def _ssn(self, v: str) -> str | None:
        """Area 001-899 but 666, group and serial not zero, and the pseudonym likewise."""
        areas = 898
        area, group, serial = map(int, v.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        n = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        n, serial = divmod(self.number("ssn", n, areas * 99 * 9999), 9999)
        area, group = divmod(n, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03}-{group + 1:02}-{serial + 1:04}"

    def _iban(self, v: str) -> str | None:
        """Country stays; the account is permuted and the check digits made anew."""
        plain = v.replace(" ", "")

        def check(country: str, account: str) -> int:
            return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97

        if not 15 <= len(plain) <= 34 or f"{check(plain[:2], plain[4:]):02}" != plain[2:4]:
            return None
        account = self.signs("iban" + plain[:2], plain[4:])
        return _into(v, plain[:2] + f"{check(plain[:2], account):02}" + account)

    def _card(self, v: str) -> str | None:
        """The Luhn sum of the places moved by one stays too, so that a longer number around the card still fails or passes."""
        digits = re.sub(r"\D", "", v)
        if not luhn_ok(digits):
            return None
        n = len(digits) - 1
        moved, got = _luhn_sum(digits + "0") % 10, ""
        while not got or _luhn_sum(got + "0") % 10 != moved:
            body = f"{self.number('card', int((got or digits)[:n]), 10**n):0{n}}"
            got = body + str(-_luhn_sum(body + "0") % 10)
        return _into(v, got)

    def _phone(self, v: str) -> str:
        """The country code stays, all other digits are permuted together."""
        code = m[0] if (m := re.match(r"\+\d{1,3}(?=[ .\-(])", v)) else v[:2] if v.startswith("+") else ""
        return code + self.signs("phone" + code, v[len(code) :])

    def _secret(self, v: str) -> str:
        got = f"{self.number('secret', int(v, 16), 16 ** len(v)):0{len(v)}x}"
        return got if v == v.lower() else got.upper()


def _into(form: str, signs: str) -> str:
    """The signs in the places of the form's letters and digits."""
    it = iter(signs)
    return "".join(next(it) if c.isalnum() else c for c in form)


def _candidates(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """Kinds and ends of the values that may start where the match does: the match, its shorter forms, other kinds."""
    a = m.start()
    yield m.lastgroup or "", m.end()
    for kind, form in EACH.items():
        if found := form.match(text, a):
            if kind != m.lastgroup:
                yield kind, found.end()
            if kind in ("card", "iban"):
                for i in reversed([i for i, c in enumerate(found[0]) if c in " -"]):
                    n = sum(map(str.isalnum, found[0][:i]))
                    if 13 <= n <= 19 if kind == "card" else n == IBAN_LENGTHS.get(found[0][:2], n):
                        yield kind, a + i


def replace(text: str, to: Pseudonyms) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind had one.

    What fails the check of its kind may hold a value that passes: shorter forms and other kinds are tried,
    then the signs behind its first one. Such a value's pseudonym is permuted on while with it something passes
    that failed before, so that the way back, from the last value to the first, finds the same values."""
    spans: list[tuple[str, int, int, list[tuple[str, int, int]]]] = []
    failed: list[tuple[str, int, int]] = []
    at = 0
    while m := FOUND.search(text, at):
        a = m.start()
        at = a + 1
        failed = [x for x in failed if x[2] > a]
        for kind, z in _candidates(text, m):
            if to.of(kind, text[a:z]) is not None:
                spans.append((kind, a, z, list(failed)))
                at = z
                break
            failed.append((kind, a, z))
    counts: dict[str, int] = {}
    now = list(text) if any(x[3] for x in spans) else []
    new = []
    for kind, a, z, near in reversed(spans) if to.back else spans:
        got = to.of(kind, text[a:z])
        if near and len(got) == z - a:
            now[a:z] = got
            while any(to.of(k, "".join(now[i:j])) is not None for k, i, j in near):
                got = to.of(kind, got)
                now[a:z] = got
        counts[kind] = counts.get(kind, 0) + 1
        new.append((a, z, got))
    out, done = [], 0
    for a, z, got in sorted(new):
        out += [text[done:a], got]
        done = z
    return "".join([*out, text[done:]]), counts


#: Texts with neither can hold no value of any kind: addresses have an at sign, all others digits.
MAYBE = re.compile(r"@|\d")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """Puts pseudonyms into the text column, and adds pii_counts (map of kind to number), in place of a column of
    that name.

    key: the secret with which `back` undoes them. A null text stays null with an empty map, an empty one stays;
    other columns stay, and equal rows get equal texts. Rows are independent: no shuffle."""
    out = T.StructType([T.StructField("text", T.StringType()), T.StructField("counts", T.MapType(T.StringType(), T.LongType()))])

    @F.pandas_udf(out)
    def put(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        to = Pseudonyms(key, back)
        for s in batches:
            got = [(None, {}) if t is None else replace(t, to) if MAYBE.search(t) else (t, {}) for t in s]
            yield pd.DataFrame({"text": [x[0] for x in got], "counts": [x[1] for x in got]})

    made = free(docs, "_pii")
    got = docs.withColumn(made, put(F.col(f"`{text}`")))
    return got.withColumns({text: F.col(f"{made}.text"), "pii_counts": F.col(f"{made}.counts")}).drop(made)


def key_of(spark: SparkSession) -> str:
    """The key that the session names in spark.skeinflow.pseudonyms.key; without one, a sample key, whose pseudonyms
    any reader of this file can undo."""
    return spark.conf.get("spark.skeinflow.pseudonyms.key", "a sample key, not a secret")


def pii_report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with pseudonyms, its SHA-256, and the number of values by kind and in all."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    n = F.aggregate(F.map_values("pii_counts"), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "text", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256"), n.alias("n_values"), *[F.coalesce(F.col("pii_counts")[k], F.lit(0).cast("long")).alias(f"n_{k}") for k in sorted(FOUND.groupindex)])
