"""A training corpus from documents: languages, exact and near copies, the mix of sources, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidyshelf.llm import stages
from tidyshelf.llm.common import documents, new_dir, table_at


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_languages(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_first_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.keep_one_of_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.to_target_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Learned models and the packing program have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


#: Of texts that go to a Python worker at a time: batches lie in the JVM beside its heap, and in the worker, in all stages of one session.
BATCH_BYTES = 4 << 20


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # stays set, as the result is lazy
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table_at(stage(spark, docs, sf_dir), new_dir(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
