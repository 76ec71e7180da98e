"""Text and number rules of ECMAScript as column expressions, where Spark's own functions differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of ECMAScript, as a regular expression class that Java and RE2 both read.
SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Fixed value: the same, sign by sign.
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Decimal numbers with sign, fraction and exponent; hexadecimal, octal and binary forms are not taken.
DECIMAL = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"
MARKER = "{TOPIC}"


def trim(text: Column) -> Column:
    """Without white space at both ends; null stays null."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def blank(text: Column) -> Column:
    """Whether a text is null, empty or white space."""
    return trim(F.coalesce(text, F.lit(""))) == ""


def present(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def replace_first(template: Column, value: Column, marker: str = MARKER) -> Column:
    """The template with its first marker replaced. In the value `$$` stands for a dollar sign, `$&` for the
    marker, and a dollar sign with a back quote or an apostrophe for what is before or after the marker; any
    other dollar sign is itself."""
    at = F.locate(marker, template)
    before, after = F.substring(template, F.lit(1), at - 1), F.substring(template, at + len(marker), F.length(template))
    pieces = F.regexp_extract_all(value, F.lit(r"\$[$&`']|[^$]+|\$"), F.lit(0))
    spelled = F.transform(pieces, lambda p: F.when(p == "$$", F.lit("$")).when(p == "$&", F.lit(marker)).when(p == "$`", before).when(p == "$'", after).otherwise(p))
    put = F.when(F.contains(value, F.lit("$")), F.array_join(spelled, "")).otherwise(value)
    return F.when(at > 0, F.concat(before, put, after)).otherwise(template)


def number(text: Column) -> Column:
    """The number that a text field holds: blank is 0, what is no decimal number is NaN."""
    t = trim(F.coalesce(text, F.lit("")))
    infinite = F.when(t.isin("Infinity", "+Infinity"), F.lit(float("inf"))).when(t == "-Infinity", F.lit(float("-inf")))
    return F.when(t == "", F.lit(0.0)).when(t.rlike(DECIMAL), t.try_cast("double")).otherwise(F.coalesce(infinite, F.lit(float("nan"))))


def finite(value: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
