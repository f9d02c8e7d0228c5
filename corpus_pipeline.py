"""A corpus pipeline of five stages, each calling one operator of ``daftar.llm``.

Each stage gets what its predecessor kept.  All but the last return the columns
of documents; the last returns the encoded corpus, one row per document.
Between stages ``run`` writes the rows as Parquet in the session's shared folder, where only the last
of these tables stays.

Defined cases: null text is empty to the classifier and passes the stages after it if it is
accepted; empty and very long texts count whole; of repeated rows one stays; ties are
broken as ``near_duplicates`` says; an empty table passes through every stage.  Extra columns of
any name pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm import bpe, decontaminate, near_duplicates, pii, quality_model
from daftar.llm.registry import rank_file, table
from daftar.llm.scratch import Scratch

#: SQL can't express the classifier, the signatures or the merges; tests compare stages with brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is, where the table has that column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = table(spark, sf_dir, "labels")
    model = quality_model.train(docs.where(~quality_model.held_out()), labels)
    return quality_model.accept(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return near_duplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind."""
    return _counted(pii.redact(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(docs, rank_file(), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop_all_but(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
