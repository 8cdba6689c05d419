"""Corpus pipeline: language ID, quality rules, near copies, personal data, packing.

``STAGES``: (name, function) in order. Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. Each stage works on all that the one before kept, written and read again.

Rows with nulls, empty texts and repeats are handled as each operator's module states: texts without letters go
in the first stage, rows without id pass the third, an empty table comes out empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shapeloom.llm import jaccard, langid, packing, pii, quality_rules
from shapeloom.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of which most words are in no known language."""
    return langid.accepted(docs, langid.train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose n-grams are unlike trusted text: labelled good and not toxic."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality_rules.accepted(docs, trusted)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard.representatives(docs, least=jaccard.NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in the texts."""
    return pii.redact(docs, length="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in sequences of 2,048 words."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality_rules", quality),
    ("near_copies", near_copies),
    ("pii", personal_data),
    ("packing", packed),
]

#: Trained models and hashed sets have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a written table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.option("compression", "zstd").parquet(path := f"{base}/{k}-{name}")
        docs = spark.read.parquet(path)
    raise ValueError("STAGES is empty")
