"""Prompts for the answer model: a template with the topic in it, a fixed policy, and the messages of a request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import jstext

# The default topic and template, and the policy below every template.
DEFAULT_TOPIC = "General business discussion"
DEFAULT_TEMPLATE = "You are helping a caller during a live meeting. Only answer questions about: {TOPIC}."
POLICY = [
    "",
    "Policy:",
    "1) You are strictly scoped to the topic above.",
    "2) If the question is outside topic, respond exactly: Out of scope for current topic.",
    "3) Do not invent facts, commands, modules, or parameters.",
    "4) If unsure but in-scope, respond exactly: I am not fully certain. Please verify in official documentation.",
    "5) Keep in-scope answers concise: max 3 short bullet points.",
    "6) Prefer concrete, actionable output over explanation.",
]


def system_prompt(template: Column, topic: Column) -> Column:
    """The template with the topic in place of its first marker, then the policy, one line each."""
    return F.concat_ws("\n", jstext.replace_first(template, topic), *[F.lit(x) for x in POLICY])


def messages(template: Column, topic: Column, question: Column) -> Column:
    """The messages of a request: array of (role, content), the system's first."""
    say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(say("system", system_prompt(template, topic)), say("user", question))
