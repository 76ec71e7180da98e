"""Answers to questions: requests, providers that stream pieces of text, and the events they make.

A provider is any callable that takes a request (topic, template, question) and yields pieces of text. The one
here is a stand-in without a network: its answers depend on the question alone."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import stored


@dataclass(frozen=True)
class Request:
    topic: str
    template: str
    question: str


Provider = Callable[[Request], Iterable[str]]


def echo(request: Request) -> Iterator[str]:
    """Pieces of 'You asked: ...', a word each with the space before it."""
    yield "You asked:"
    for word in re.findall(r"[^ ]+", request.question):
        yield f" {word}"


def stream(requests: DataFrame, provider: Provider = echo) -> DataFrame:
    """The columns of `requests` (topic, template, question and others) with `chunk_idx` and `chunk`, one row for
    each piece that isn't empty; their numbers tell the order. Null fields count as empty. A provider that fails
    ends its answer with the pieces it gave.
    Each request is answered in the task that reads it: no shuffle."""
    return told(requests, provider).where("chunk is not null").drop("failure")


def told(requests: DataFrame, provider: Provider = echo) -> DataFrame:
    """What `stream` gives, and a last row of each answer, whose chunk is null and whose `failure` has the message of
    the provider's error, if it failed."""
    none = F.lit(None).cast("string")
    schema = requests.withColumns({"chunk_idx": F.lit(0), "chunk": none, "failure": none}).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, idx, chunk, failure = [], [], [], []

            def put(row: int, i: int, piece: str | None, error: str | None = None) -> None:
                for held, x in ((at, row), (idx, i), (chunk, piece), (failure, error)):
                    held.append(x)

            for row, (topic, template, question) in enumerate(zip(pdf["topic"], pdf["template"], pdf["question"], strict=True)):
                i, error = 0, None
                try:
                    for piece in provider(Request(topic or "", template or "", question or "")):
                        if piece:
                            put(row, i, piece)
                            i += 1
                except Exception as e:  # a provider may fail in any way; the other answers go on
                    error = str(e) or type(e).__name__
                put(row, i, None, error)
            yield pdf.iloc[at].assign(chunk_idx=idx, chunk=chunk, failure=failure)

    return requests.mapInPandas(run, schema)


def conversation(finals: DataFrame, requests: DataFrame, order: list[str], provider: Provider = echo, path: str | None = None) -> DataFrame:
    """The event log of final transcripts and of the answers to their questions: session, kind, text, the order columns,
    and `step`, which puts a transcript before its chunks and these before `done`. An answer that failed has no `done`,
    so its pieces stay in the draft. Answers are written once, to `path` or the shared folder, before anything reads them:
    a provider is asked once for a request, however often the log is read."""
    return log(finals, stored(told(requests.select("session", "topic", "template", "question", *order), provider), path), order)


def log(finals: DataFrame, answers: DataFrame, order: list[str]) -> DataFrame:
    """The same from answers that are stored, as `told` gives them."""
    said = finals.select("session", F.lit("final").alias("kind"), "text", *order, F.lit(-1).alias("step"))
    rows = answers.where("chunk is not null or failure is null")
    kind = F.when(F.col("chunk").isNull(), "done").otherwise("chunk")
    return said.unionByName(rows.select("session", kind.alias("kind"), F.col("chunk").alias("text"), *order, F.col("chunk_idx").alias("step")))
