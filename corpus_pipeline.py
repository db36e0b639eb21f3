"""From raw documents to token ids: five stages, each written and read again before the next.

1. language: documents without a determined language, or below the least score, go; lang is set.
2. near_duplicates: one document of each group of near-duplicates stays.
3. personal_data: personal data in the texts is replaced.
4. source_mix: documents as often, and in the order, as the source weights say.
5. token_ids: every text as SentencePiece ids.

Every stage takes null values in any column, very long texts, further columns of any name (kept by all
but the last) and empty tables, which stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import discard, materialize, read_table
from strandloom.llm.langid import accepted
from strandloom.llm.mixing import mixed_documents
from strandloom.llm.ngram_join import keep_one
from strandloom.llm.pii import sanitised
from strandloom.llm.sentencepiece_codec import encode, model_bytes


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a determined language, with lang set. Null texts and texts without a letter go; repeated rows stay or go together."""
    return accepted(docs, least=0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links: that of the smallest doc_id (null: the largest), then of the smallest text hash. Documents without words all stay; of rows equal in doc_id and text one stays."""
    return keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data, secrets and disclosing terms replaced. Null and empty texts stay as they are, as do repeated rows."""
    return sanitised(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, whole. Documents without words are not taken; null sources are one source; each of repeated rows has its turns."""
    return mixed_documents(docs, weights=(5, 2, 1), cap=3)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids and ids of every row, repeated ones too; null and empty texts have no ids."""
    return encode(docs, model_bytes()).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Trained weights, similarity groups and best paths have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
