"""Which utterances are questions: an ordered set of rules over the words of a text, with a code for each rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jstext

# The vocabulary of the rules.
WH = "what why how when where who whom whose which".split()
AUXILIARIES = "can could would should do does did is are was were will have has am may".split()
TARGETS = "you we i it this that there they he she".split()
PREFIXES = ["i think", "i believe", "we think", "we believe", "this is", "that is", "it is", "we are", "i am"]
#: Characters that part words beside white space.
PUNCTUATION = r'[.,!;:()\[\]"]'
#: Fewer words are no question unless a question mark ends them.
LEAST_WORDS = 3


def normal(text: Column) -> Column:
    """Trimmed and in lower case; null counts as empty."""
    return F.lower(jstext.trim(F.coalesce(text, F.lit(""))))


def words(normalised: Column) -> Column:
    """The words of a normalised text."""
    return F.filter(F.split(F.regexp_replace(normalised, PUNCTUATION, " "), jstext.SPACE + "+"), lambda w: w != "")


def word(list_: Column, i: int) -> Column:
    """Word i of a list, empty beyond its end."""
    return F.coalesce(F.get(list_, F.lit(i)), F.lit(""))


def reason(normalised: Column, list_: Column) -> Column:
    """The code of the first rule that decides a text."""
    first = word(list_, 0)
    opens = [normalised.startswith(p) for p in PREFIXES]
    prefixed = opens[0]
    for x in opens[1:]:
        prefixed = prefixed | x
    return (
        F.when(normalised == "", "empty")
        .when(normalised.endswith("?"), "qmark")
        .when(prefixed, "prefix")
        .when(F.size(list_) < LEAST_WORDS, "short")
        .when(first.isin(WH), "wh")
        .when(first.isin(AUXILIARIES) & word(list_, 1).isin(TARGETS), "aux")
        .otherwise("none")
    )


def is_question(code: Column) -> Column:
    """Whether a rule's code makes its text a question."""
    return code.isin("qmark", "wh", "aux")


def classified(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds `words` (array of string), `reason` and `is_question`; columns of these names are replaced.
    The words are projected once, below the rules, so that no rule splits the text again."""
    named = rows.withColumn("_normal", normal(F.col(text)))
    split = named.withColumn("words", words(F.col("_normal")))
    return split.withColumn("reason", reason(F.col("_normal"), F.col("words"))).withColumn("is_question", is_question(F.col("reason"))).drop("_normal")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is worked out once however often `body` uses it, also in a filter that Spark pushes
    below what it reads."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def gate(rows: DataFrame, text: str = "text", final: str | None = None) -> DataFrame:
    """The rows whose text is a question, and of them the final ones where a column tells; columns stay as they are."""
    code = _let(normal(F.col(text)), lambda t: _let(words(t), lambda list_: reason(t, list_)))
    kept = rows.where(is_question(code))
    return kept.where(F.coalesce(F.col(f"`{final}`"), F.lit(False))) if final else kept
