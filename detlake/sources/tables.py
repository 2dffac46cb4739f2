"""Parquet, CSV and JSON-lines readers with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from detlake import fixed_values as fv, schema
from detlake.functions.numeric import nan_to_null
from detlake.operators.quality import assert_contract


def scan_csv_index(
    spark: SparkSession, path: str, columns: list[str] = schema.INDEX_COLUMNS
) -> DataFrame:
    """Header CSV with every column a string and missing-value tokens as NULL."""
    declared = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(declared).csv(path, header=True, quote='"', escape='"')
    return raw.select(*[na_token_to_null(F.col(c)).alias(c) for c in columns])


def na_token_to_null(col) -> F.Column:
    return F.when(col.isin(fv.CSV_NA_TOKENS), None).otherwise(col)


def scan_manifest(
    spark: SparkSession, path: str, columns: list[str] | None = None
) -> DataFrame:
    """Manifest rows with only the columns asked for in the scan."""
    return spark.read.schema(schema.MANIFEST).parquet(path).select(
        *(columns or schema.MANIFEST.names)
    )


def table_rowcount(df: DataFrame) -> DataFrame:
    """Row count as a one-row table; a Parquet scan reads no column for it."""
    return df.agg(F.count("*").alias("n_rows"))


def footer_rowcount(spark: SparkSession, path: str) -> DataFrame:
    """Row count of Parquet files from their footers alone.

    The count is pushed into the scan, which the second version of Spark's file
    sources can; a session of its own carries that setting, the caller's stays as it is.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return table_rowcount(own.read.parquet(path))


def scan_history(
    spark: SparkSession, path: str, table_schema: T.StructType = schema.HISTORY
) -> DataFrame:
    """JSON lines in write order, malformed and blank lines dropped.

    ``seq`` orders records by append: newer files after older ones, then the
    place inside the file. NaN metrics become NULL.
    """
    raw = (
        spark.read.schema(table_schema)
        .option("mode", "DROPMALFORMED")
        .option("allowNonNumericNumbers", "true")
        .json(path)
    )
    cols = [
        nan_to_null(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in table_schema.fields
    ]
    seq = F.struct(
        F.col("_metadata.file_modification_time").alias("written"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    return raw.select(*cols, seq.alias("seq"))


def scan_features(
    spark: SparkSession,
    root: str,
    feature_id: str,
    dataset_ids: list[str] | None = None,
    channels: int | None = None,
) -> DataFrame:
    """Finished feature matrices of one parameter set; both filters prune folders.

    With ``channels`` the contract is checked on what is read, and a frame of
    another width or with NaN or Inf stops the job.
    """
    df = spark.read.parquet(root).filter(
        (F.col("feature_id") == feature_id) & (F.col("status") == "ok")
    )
    if dataset_ids is not None:
        df = df.filter(F.col("dataset_id").isin(dataset_ids))
    if channels is not None:
        assert_contract(df, channels)
    return df
