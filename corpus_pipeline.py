"""Training-corpus pipeline: quality, near copies, benchmark leaks, personal data, tokens.

STAGES are applied in order to `documents`; each one's rows are written as Parquet and read again as the next
one's input. All but the last return the columns of `documents`; the last adds the tokens' figures.

For every stage: empty tables give empty tables; a null or empty text is a document without words; a null doc_id is an
id of its own; rows that are equal in all columns are treated alike (near dedup keeps one of them); columns beside
doc_id and text pass through, whatever their names, but for those a stage adds. Texts are read whole, however long.
Folders of earlier stages stay in the shared folder, for a run that must be looked into; they are the cluster's to clear."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skeinflow.llm import bpe, decontamination, near_duplicates, pii, quality_model
from skeinflow.llm.common import shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects as junk or toxic. Without labels of both kinds none is."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one of the least doc_id; nulls come last. Documents without
    words all stay."""
    return near_duplicates.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; null and empty ones stay, and all do without items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data, and counts the characters anew. A null text stays null and keeps its count."""
    got = pii.pseudonymise(docs, pii.key_of(spark)).drop("pii_counts")
    return got.selectExpr(*["cast(coalesce(char_length(text), n_chars) as bigint) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and the digests of ids and decoded text; a null text has those of an empty one."""
    return bpe.with_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", private),
    ("bpe", tokens),
]

#: The classifier, the alignment and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
