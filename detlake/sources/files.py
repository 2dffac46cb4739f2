"""Files that executors reach themselves: walked folder by folder, sized and read by path.

Paths go through Arrow's file systems (local or mounted folders, HDFS, S3, GCS, Azure),
so no file index is made on the driver and no content passes through a shuffle. A store that
only Spark's readers can open is told by :func:`reachable`.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake.session import materialize, ship_package

DEEPEST = 64  # levels of folders; more is taken for a loop of links
STEP = 1000   # paths asked for at once
BLOCK = 8 << 20  # bytes hashed at once


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root folder and its path there."""
    root = re.sub("^file:/+", "/", root)
    found, path = fs.FileSystem.from_uri(root.rstrip("/") or "/")
    return found, path.rstrip("/")


def reachable(root: str) -> bool:
    """Whether executors can open paths below ``root`` without Spark's readers."""
    try:
        open_root(root)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _hidden(name: str) -> bool:
    """Names that Spark's own readers pass over too: work in progress and marks."""
    return name.startswith((".", "_"))


def _list_folders(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                rows = []
                for entry in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/") or "/", allow_not_found=True)):
                    if not _hidden(entry.base_name):
                        below = f"{folder}/{entry.base_name}" if folder else entry.base_name
                        rows.append((below, entry.type == fs.FileType.Directory, entry.size))
                columns = list(zip(*rows)) if rows else [(), (), ()]
                kinds = (pa.string(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "folder", "length"])

    return run


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Files below ``root``: ``path`` relative to it and ``length``, listed by the executors.

    Each level of folders is one job that spreads the folders over all cores; what it
    finds is a stored table, so the driver holds no names.
    """
    ship_package(spark)
    folders, found = spark.createDataFrame([("",)], "path string"), None
    for _ in range(DEEPEST):
        entries = materialize(folders.mapInArrow(_list_folders(root), "path string, folder boolean, length bigint"), "walk")
        files = entries.filter("not folder").select("path", "length")
        found = files if found is None else found.unionByName(files)
        folders = entries.filter("folder").select("path")
        if folders.isEmpty():
            return found
        folders = folders.repartition(spark.sparkContext.defaultParallelism)
    raise ValueError(f"more than {DEEPEST} levels of folders below {root}")


def add_lengths(paths: DataFrame, root: str) -> DataFrame:
    """Add ``length`` to a table with a relative ``path``: asked of the store, NULL where there is no file."""
    ship_package(paths.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema)
    columns = paths.columns
    at = columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for whole in batches:
            for first in range(0, len(whole), STEP):
                batch = whole.slice(first, STEP)
                names = batch.column(at).to_pylist()
                info = iter(store.get_file_info([f"{base}/{p}" for p in names if p]))
                sizes = [next(info) if p else None for p in names]
                sizes = [i.size if i is not None and i.is_file else None for i in sizes]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], [*columns, "length"])

    return paths.mapInArrow(run, f"{schema}, length bigint")


def content_digests(spark: SparkSession, root: str) -> DataFrame:
    """``path``, ``length`` and ``digest`` of every file below a folder, or of one file (its own name as path).

    A file's digest is the SHA-256 of the hexadecimal SHA-256 of its blocks of ``BLOCK``
    bytes, one after the other, so the blocks of one large file are hashed by many tasks.
    """
    ship_package(spark)
    store, base = open_root(root)
    if store.get_file_info(base).is_file:
        folder, _, name = root.rstrip("/").rpartition("/")
        found = add_lengths(spark.createDataFrame([(name,)], "path string"), folder)
    else:
        folder, found = root, walk(spark, root)
    last = F.greatest(F.ceil(F.col("length") / BLOCK) - 1, F.lit(0)).cast("long")
    blocks = found.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition(spark.sparkContext.defaultParallelism, "path", "block")
    hashed = blocks.mapInArrow(_hash_blocks(folder), "path string, length bigint, block bigint, hash string")
    in_order = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "hash"))), lambda b: b["hash"]), "")
    return hashed.groupBy("path", "length").agg(F.sha2(in_order, 256).alias("digest"))


def _hash_blocks(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            out = []
            for path, block in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                with store.open_input_file(f"{base}/{path}") as f:
                    f.seek(block * BLOCK)
                    out.append(hashlib.sha256(f.read(BLOCK)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["path", "length", "block", "hash"])

    return run


def content_digest(spark: SparkSession, root: str) -> str:
    """One SHA-256 over the names and digests of all files below ``root``, in order of their names."""
    line = F.concat_ws(":", "path", "digest")
    lines = content_digests(spark, root).agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("all"))
    return lines.select(F.sha2("all", 256)).first()[0]


def write_files(rows: DataFrame, root: str) -> int:
    """Write each row's ``content`` to ``root/path`` and say how many; a repeated task writes the same bytes again."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                place = f"{base}/{path}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                part = f"{place.rpartition('/')[0]}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, place)
            yield batch.select(["path"])

    return rows.select("path", "content").mapInArrow(run, "path string").agg(F.count("*")).first()[0]
