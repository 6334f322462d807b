"""From documents to packed training sequences, one operator of the package a stage.

Each stage takes what the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from offerlens.llm import chaining, jaccard, packing, quality, surrogates
from offerlens.llm.arrow import BATCH_BYTES
from offerlens.llm.queries import table, tokenizer_path
from offerlens.session import checkpoint_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SENT = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(stage: Stage) -> Stage:
    """Operators read batches of ``BATCH_BYTES``; with this setting they are also sent so,
    else Spark sends up to 10 000 rows at once, held in the JVM and in Python. It stays
    set for the caller, who writes what the stage returns; a limit of the caller's own
    stays too."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(_SENT, None) is None:
            spark.conf.set(_SENT, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep. The classifier learns
    from the labels and the table they belong to."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


@in_small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join stays, the one of least key."""
    return jaccard.keep_first(docs)


@in_small_batches
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages stay in the document that holds them first and are cut elsewhere."""
    return chaining.drop_repeated(docs)


@in_small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data and secrets."""
    return surrogates.pseudonymize(docs)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in padded sequences."""
    return packing.pack_documents(docs, tokenizer_path()).drop("ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules), ("ngram_jaccard", near_copies), ("substring_dedup", repeated_passages),
    ("pii", personal_data), ("packing", pack),
]

# A classifier, chains of matches and keyed surrogates have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = os.path.join(checkpoint_folder(spark), "corpus_pipeline", spark.sparkContext.applicationId)
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = f"{folder}/{os.urandom(6).hex()}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
