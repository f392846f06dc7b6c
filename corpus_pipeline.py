"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns is written as Parquet
and read again as the next stage's documents. All but the last return the columns of documents.

The stages train classifiers and shingle texts, which SQL can't express, so ORACLE_SQL is None and the tests compare the
result with brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bookflow.llm import exact_dedup, near_dup, packing, quality, toxicity
from bookflow.llm.common import materialize, table
from bookflow.llm.queries import tokenizer
from bookflow.runtime import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), whole=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, tokenizer(), end_id=1)


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
