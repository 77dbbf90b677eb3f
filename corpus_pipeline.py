"""The corpus pipeline: stages over documents, each working on all that its predecessor kept.

Languages are identified and documents of none are dropped; quality rules drop boilerplate; of
each group of near copies one document stays; secrets are masked; what is left is packed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm import languages, packing, quality, secret_scan, shingle_join
from barquarry.llm.common import labelled_sample, read, stored

#: Near copies: sets of so many words, shared to this percentage or more.
NEAR_COPY_WORDS, NEAR_COPY_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; models are fitted on a sample of the given documents."""
    return languages.keep_identified(docs, languages.train(languages.training_rows(docs)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    rows = labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", quality.TRAINING_DOCS, seed=3)
    return quality.keep_quality(docs, quality.train(rows))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return shingle_join.one_of_each_group(docs, NEAR_COPY_WORDS, NEAR_COPY_PERCENT)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked and n_chars counted anew there."""
    before = f"_{uuid.uuid4().hex}"
    masked = secret_scan.mask_secrets(docs.withColumn(before, F.xxhash64("text")))
    changed = F.xxhash64("text") != F.col(before)
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).drop(before)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("secrets", secrets),
    ("packing", packed),
]

#: Models and the packing search cannot be stated in SQL; tests hold the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written before the next one reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
