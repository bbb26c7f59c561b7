"""Corpus pipeline: raw documents to training-order token shards.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``.  ``run`` writes a stage's
result as Parquet to the shared folder and reads it back as the next one's
documents, so a lost executor costs one stage's task, not the pipeline.  All
stages but the last keep the columns of ``documents``:

1. quality classifier: what the importance resampling doesn't draw goes;
2. near-duplicates: the document with the smallest id of each class stays;
3. decontamination: documents with a benchmark passage go;
4. mixing: documents are dropped or repeated to meet the sources' targets;
5. token output: one row for each sequence, in its slot of the written shards.

An empty table of documents goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from razao.llm import decontaminate, mixing, near_dedup, quality_classifier, token_output
from razao.llm.tables import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.digest(token_output.training_order(docs))


STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_output", token_shards),
]

#: hashed models, MinHash and permutations have no SQL; the tests hold each
#: stage against a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
