"""Whitespace-separated label protocols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from detlake.functions.paths import plain_path


def read_protocol(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per non-blank line: ``file``, ``block``, ``pos``, ``parts``.

    ``(file, block, pos)`` sorts lines as they stand in their file: a scan task
    reads one byte range (block) front to back and ``pos`` grows inside it.
    """
    lines = spark.read.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        split_fields(F.col("value")).alias("parts"),
    )
    return lines.filter(F.size("parts") > 0)


def split_fields(line) -> F.Column:
    """Fields between runs of white space; a blank line has none."""
    return F.filter(F.split(line, r"\s+"), lambda field: field != "")


def needed_width(fields: dict[str, int], min_fields: int | None = None) -> int:
    return min_fields if min_fields is not None else max(fields.values()) + 1


def protocol_fields(
    lines: DataFrame, fields: dict[str, int], min_fields: int | None = None
) -> DataFrame:
    """Named columns by position, for the lines that are wide enough.

    Short lines are what :func:`short_lines` reports; the two are disjoint and
    together cover every line.
    """
    need = needed_width(fields, min_fields)
    keep = [c for c in lines.columns if c != "parts"]
    return lines.filter(F.size("parts") >= need).select(
        *keep, *[F.get("parts", F.lit(i)).alias(name) for name, i in fields.items()]
    )


def short_lines(
    lines: DataFrame, fields: dict[str, int], min_fields: int | None = None
) -> DataFrame:
    """Lines too narrow for the layout."""
    need = needed_width(fields, min_fields)
    return lines.filter(F.size("parts") < need).withColumn("n_fields", F.size("parts"))


def with_line_number(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, counting the non-blank lines of each file from 1.

    A block is at most one input split, so numbering inside a block is bounded
    work; blocks are joined up through their line counts, not through one task
    per file.
    """
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = blocks.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("file", "block").orderBy("pos")
    return (
        lines.join(offsets, ["file", "block"])
        .withColumn("line_no", F.col("offset") + F.row_number().over(inside))
        .drop("offset")
    )
