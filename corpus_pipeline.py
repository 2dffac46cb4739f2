"""From documents to a training mix, stage by stage.

Every stage works on what the stage before kept; its result is written as Parquet in
the shared folder and read again. A stage takes ``(spark, docs, sf_dir)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detlake.llm import decontaminate, langid, mixing, passages, simhash
from detlake.llm.sample import fold
from detlake.session import materialize, ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a language that is likelier than not."""
    return langid.keep_known(docs, langid.fit(docs, fold(4) != 2))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that an earlier document holds; drop what is left empty."""
    return passages.cut_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample towards softened shares of sources, languages and topics; adds ``topic`` and ``prob``."""
    return mixing.sample(docs)


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _shipped(f)) for f in (language, near_duplicates, repeated_passages, benchmark, mix)]

ORACLE_SQL = None  # hashes, embeddings and a fitted model: the tests compare with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
