"""The corpus pipeline: what a training corpus goes through, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``docs``. ``run``
writes each result to the shared folder before the next stage reads it, so no stage computes its predecessors anew and a
lost executor costs no more than a stage's tasks.

Rows that a stage removes: those the quality classifier scores below 0.3; of equal texts all but the smallest id; of
each group of near duplicates all but the document with the smallest id; contaminated documents. Nulls, empty tables
and repeated rows are as the operators define them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, encoding, exact_dedup, quality, simhash
from lodestrata.llm.common import documents, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, train=quality.fold("doc_id", 5) != 0)
    return quality.keep_good(docs, model, threshold=0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, width=3, radius=3, seed=42)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=13, per_hit=20)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encoding.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("byte_level_bpe", encoding_stage),
]

#: A fitted model and SimHash groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
