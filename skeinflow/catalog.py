"""All queries by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import calls, conversation, signals, spans, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return conversation.QUERIES | calls.QUERIES | signals.QUERIES | streams.QUERIES | spans.QUERIES


def oracle_sql() -> dict[str, str]:
    return conversation.SQL | calls.SQL | signals.SQL | streams.SQL | spans.SQL
