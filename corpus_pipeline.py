"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding.

Each stage takes all documents that the one before kept; its result is written
as Parquet and read again. Every stage but the last returns the columns of
documents; the last returns the shard and slot of every row.

Defined results: a null or empty text has no words, so the quality rules reject
it; a null id is judged like any other and kept once per text by the near-dedup;
repeated rows are one document after it; of equal documents the one of the
smallest id stays; ties of weights and cuts are those of the stage's operator;
very long texts are read whole by every stage; empty tables give empty results,
without labels nothing is rejected by the ratio and every rate is 1; columns of
documents may have any names, also those that an operator's result has.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from episodia.llm.common import discard, scratch, small_batches, table
from episodia.llm.decontaminate import clean_documents
from episodia.llm.mixing import mixed
from episodia.llm.quality_rules import keep_good
from episodia.llm.sharding import sharded
from episodia.llm.simhash import keep_one


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, table(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded(docs)


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("sharding", sharding),
]
#: The scores and fingerprints of the stages are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        if k:
            discard(spark, f"{base}/{k - 1}")
        docs = spark.read.parquet(f"{base}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
