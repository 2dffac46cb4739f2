"""Audio file listings, without reading any content."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake import fixed_values as fv
from detlake.functions.paths import plain_path, relative_to, stem, suffix
from detlake.sources.files import reachable, walk


def scan_audio_listing(spark: SparkSession, root: str) -> DataFrame:
    """Every audio file below ``root``: ``path``, ``rel``, ``stem``, ``suffix``, ``length``.

    The executors walk the folders; only a store that nothing but Spark can open is listed by
    its file source, without selecting ``content``.
    """
    if reachable(root):
        base = re.sub("^file:/+", "/", root).rstrip("/")
        files = walk(spark, root).select(F.concat(F.lit(f"{base}/"), "path").alias("path"), "length")
        return describe_listing(files, base)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(plain_path(F.col("path")).alias("path"), "length")
    )
    return describe_listing(files, root)


def describe_listing(files: DataFrame, root: str = "") -> DataFrame:
    """Keep audio suffixes (any case) and add the parts of each path."""
    rel = relative_to(F.col("path"), root) if root else F.col("path")
    return (
        files.filter(F.lower(suffix(F.col("path"))).isin(fv.AUDIO_SUFFIXES))
        .withColumn("rel", rel)
        .withColumn("stem", stem(F.col("path")))
        .withColumn("suffix", suffix(F.col("path")))
    )
