"""Writers: versioned tables, score parts, histories and CSV."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake import fixed_values as fv
from detlake.operators.resume import history_truncate, latest_wins
from detlake.session import shared_path


def write_table_atomic(df: DataFrame, root: str) -> str:
    """Write ``df`` as a new version below ``root`` and return its path.

    A version is never written to again, so readers of an older path are not
    disturbed; the caller hands the new path on once this returns.
    """
    path = f"{root}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_table(df: DataFrame, name: str, root: str) -> str:
    """Make ``df`` the content of the catalog table ``name``: a new version below ``root``, then one switch.

    Until the switch the name means the old version and after it the new one; readers that have
    begun keep theirs, as versions are never written to again (:func:`expire_versions` removes
    old ones). The first version creates the table. Other columns than the table's raise
    ``ValueError`` before anything is written.
    """
    spark = df.sparkSession
    known = spark.catalog.tableExists(name)
    if known:
        columns = lambda t: [(f.name, f.dataType) for f in t.schema]
        if columns(spark.table(name)) != columns(df):
            raise ValueError(f"{name} has the columns {spark.table(name).schema.simpleString()}")
    path = write_table_atomic(df, root)
    if known:
        spark.sql(f"alter table {name} set location '{path}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"create table {name} using parquet location '{path}'")
    return path


def table_location(spark: SparkSession, name: str) -> str:
    """The folder a catalog table means now."""
    rows = spark.sql(f"describe table extended {name}").filter(F.col("col_name") == "Location")
    return rows.first()["data_type"]


def expire_versions(spark: SparkSession, name: str, root: str, keep: int = 1) -> int:
    """Remove versions below ``root`` other than the table's own and the ``keep - 1`` latest besides; say how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(root)
    store = folder.getFileSystem(conf)
    own = jvm.org.apache.hadoop.fs.Path(table_location(spark, name)).getName()
    versions = [s for s in store.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() != own]
    versions.sort(key=lambda s: (-s.getModificationTime(), s.getPath().getName()))
    for old in versions[max(keep - 1, 0):]:
        store.delete(old.getPath(), True)
    return len(versions[max(keep - 1, 0):])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, by one question to its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_score_shards(
    scores: DataFrame, root: str, run_id: str, shard_rows: int = fv.DEFAULT_SHARD_ROWS
) -> int:
    """Append scores of one run as a new part; files hold ``shard_rows`` rows at most."""
    spark = scores.sparkSession
    part = 0
    if path_exists(spark, root):
        part = (read_score_shards(spark, root, run_id).agg(F.max("part")).first()[0] or 0) + 1
    (
        scores.select("dataset_id", "utt_id", F.col("score").cast("float").alias("score"))
        .withColumn("run_id", F.lit(run_id))
        .withColumn("part", F.lit(part).cast("long"))
        .write.mode("append")
        .partitionBy("run_id", "part")
        .option("maxRecordsPerFile", shard_rows)
        .parquet(root)
    )
    return part


SHARD_SCHEMA = "dataset_id string, utt_id string, score float, run_id string, part long"


def read_score_shards(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """Parts of one run; other runs are never opened."""
    return spark.read.schema(SHARD_SCHEMA).parquet(root).filter(F.col("run_id") == run_id)


def merge_score_shards(parts: DataFrame) -> DataFrame:
    """One score per key, the last part winning."""
    return latest_wins(
        parts.select("dataset_id", "utt_id", "score", "part"), ["dataset_id", "utt_id"], ["part"]
    ).drop("part")


def append_history(records: DataFrame, path: str) -> None:
    """Append epoch records as JSON lines; NULL metrics are written as null."""
    records.write.mode("append").option("ignoreNullFields", "false").json(path)


def truncate_history(spark: SparkSession, path: str, last_epoch: int) -> None:
    """Drop records after ``last_epoch``.

    The records that stay are written to the shared folder first and that copy is
    kept, so a stop during the overwrite loses nothing.
    """
    from detlake.sources.tables import scan_history

    staged = shared_path(spark, "history")
    history = latest_wins(scan_history(spark, path), ["epoch"], ["seq"]).drop("seq")
    history_truncate(history, last_epoch).write.option("ignoreNullFields", "false").json(staged)
    spark.read.schema(history.schema).json(staged).write.mode("overwrite").option(
        "ignoreNullFields", "false"
    ).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; quotes are doubled as in the common dialect."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")
