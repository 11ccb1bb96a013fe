"""The corpus pipeline: judge, join near copies, put out personal data, mix sources, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirlog.llm import mixing, neardup, packing, pii, quality
from weirlog.scratch import Scratch


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def join_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.first_of_each(docs)


def put_out_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and places."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", judge),
    ("n-gram Jaccard join", join_copies),
    ("PII", put_out_pii),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: The classifier is trained here, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
