"""Session helpers: the shared folder and tables written to cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions

BROADCAST_ROWS = 100_000  # rows of keys and a few numbers: some megabytes


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A cluster sets ``spark.checkpoint.dir``. Only a local session without that
    setting gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fresh = tempfile.mkdtemp(prefix="detlake-", dir="/tmp")
    sc.setCheckpointDir(fresh)
    return fresh


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, never used before; :func:`discard` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_detlake_made"):
        sc._detlake_made = []
    return sc._detlake_made


def discard(spark: SparkSession) -> int:
    """Remove the intermediate tables this session has written, and say how many.

    For when every result that rests on them is stored: results are lazy, so nothing
    is removed before the caller says so.
    """
    made, jvm = _made(spark), spark.sparkContext._jvm
    for name in made:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    n = len(made)
    made.clear()
    return n


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Later passes then scan files with known sizes, prune columns, survive lost
    executors and see one fixed result.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it has at most ``max_rows`` rows.

    The count stops at the limit. A larger table comes back unmarked, so that the
    join shuffles and adaptive execution splits its skewed keys.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return functions.broadcast(df)
    return df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per session, as one zip file."""
    sc = spark.sparkContext
    if getattr(sc, "_detlake_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.TemporaryDirectory(prefix="detlake-code-")  # gone with the session
    sc.addPyFile(shutil.make_archive(os.path.join(folder.name, "detlake"), "zip", root, "detlake"))
    sc._detlake_code = folder
    sc._detlake_shipped = True
