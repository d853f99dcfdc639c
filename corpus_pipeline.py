"""The training-corpus pipeline: five operators in a row, each stage written and read again by the next.

run(spark, sf_dir) applies STAGES to the documents table. Every stage works on all that the one before it
kept: quality rules drop and clean documents, near-duplicate groups keep one document, repeated passages
are cut, sources are mixed to their target weights, and the mix is packed into sequences.

Rows with nulls, empty texts and repeats are handled as each operator's docstring says; an empty table
passes through every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.mixing import mix
from lodestone.llm.near_dedup import keep_one
from lodestone.llm.packing import packed
from lodestone.llm.quality_rules import keep_good
from lodestone.llm.shared import cut, remove, scope
from lodestone.llm.substring_dedup import cut_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packing),
]

#: Near-duplicate groups, the knapsack and the packing are not expressible in SQL; a test holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. A stage's tables are deleted once the next stage's result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark, name) as folder:
            docs = cut(stage(spark, docs, sf_dir), name)
        if before is not None:
            remove(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)
