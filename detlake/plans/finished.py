"""An index of finished keys beside a feature table, pruned by what a batch asks for.

Finished keys lie in folders by a hash of the key, so a batch reads the folders of its own
keys and not all that was ever finished. A run leaves a mark before it writes features
and one after its keys are in the index; what a stopped run may have left behind is
read from the table itself, of that run only. A table without marks (from before there
was an index) is scanned once and indexed with the next run. The folders start with
``_``, so readers of the table pass over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from detlake import schema
from detlake.sinks.tables import path_exists

BUCKETS = 256

KEYS = "dataset_id string, utt_id string, attempt long, feature_id string, bucket int"
MARKS = "feature_id string, attempt long, settled boolean"


def _bucket() -> Column:
    return F.pmod(F.xxhash64(*schema.KEY), F.lit(BUCKETS)).cast("int").alias("bucket")


def _read(spark: SparkSession, path: str, columns: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], columns)
    return spark.read.schema(columns).parquet(path)


def marks(spark: SparkSession, root: str, feature_id: str) -> dict[int, bool]:
    """Runs that have begun and whether their keys are indexed; empty where there is no index."""
    rows = _read(spark, f"{root}/_marks", MARKS).filter(F.col("feature_id") == feature_id)
    found = rows.groupBy("attempt").agg(F.bool_or("settled").alias("settled")).collect()  # one row per run
    return {r["attempt"]: r["settled"] for r in found}


def _mark(spark: SparkSession, root: str, feature_id: str, attempt: int, settled: bool) -> None:
    row = spark.createDataFrame([(feature_id, attempt, settled)], MARKS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/_marks")


def begin(spark: SparkSession, root: str, feature_id: str, attempt: int) -> None:
    """To be called before a run writes anything."""
    _mark(spark, root, feature_id, attempt, False)


def settle(done: DataFrame, root: str, feature_id: str, attempt: int, known: dict[int, bool]) -> None:
    """Index the finished keys of a run and of the stopped runs before it.

    ``done``: ``dataset_id, utt_id, attempt`` of the finished keys of the table; ``known``: the marks from
    before this run.
    """
    spark = done.sparkSession
    left = sorted({attempt, *(a for a, settled in known.items() if not settled)})
    new = done.filter(F.col("attempt").isin(left)) if known else done
    new = new.select(*schema.KEY, "attempt", F.lit(feature_id).alias("feature_id"), _bucket())
    new.repartition("bucket").write.mode("append").partitionBy("feature_id", "bucket").parquet(f"{root}/_finished")
    for a in left:
        _mark(spark, root, feature_id, a, True)


def among(keys: DataFrame, done: DataFrame, root: str, feature_id: str, known: dict[int, bool]) -> DataFrame:
    """Finished keys that may be among ``keys``: those of the index in their folders, and of stopped runs.

    A superset of what is finished among them, without other folders and runs.
    """
    if not known:
        return done.select(*schema.KEY)
    spark = keys.sparkSession
    asked = [r["bucket"] for r in keys.select(_bucket()).distinct().collect()]  # BUCKETS at most
    index = _read(spark, f"{root}/_finished", KEYS).filter((F.col("feature_id") == feature_id) & F.col("bucket").isin(asked))
    stopped = [a for a, settled in known.items() if not settled]
    return index.select(*schema.KEY).unionByName(done.filter(F.col("attempt").isin(stopped)).select(*schema.KEY)).distinct()
