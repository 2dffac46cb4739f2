"""Adapters: each turns one raw layout into the canonical manifest.

An adapter takes DataFrames (protocol lines, listing) rather than paths, so the
same code serves files, tables and tests. ``*_problems`` returns what would make
the index incomplete; ``index_*`` returns the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from detlake import fixed_values as fv
from detlake.functions import labels as L, paths as P
from detlake.operators.manifest import coerce_schema
from detlake.registry import Registry
from detlake.sources import protocol as proto
from detlake.sources.listing import describe_listing, scan_audio_listing
from detlake.sources.tables import scan_csv_index

ADAPTERS = Registry("adapter")


def missing_audio(rows: DataFrame, listing: DataFrame, on: list[str]) -> DataFrame:
    """Protocol or index rows without a file."""
    return rows.join(listing.select(*on), on, "left_anti")


def unlabelled_audio(listing: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """Files without a protocol row."""
    return listing.join(rows.select(*on), on, "left_anti")


def protocol_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that a protocol holds more than once."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def protocol_file_problems(lines: DataFrame) -> DataFrame:
    """Split words that do not have exactly one protocol file."""
    words = list(fv.NATIVE_SPLITS)
    name = F.lower(P.file_name(F.col("file")))
    matched = lines.select("file").distinct().select(
        F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)))
        .alias("split_word"),
        "file",
    )
    expected = lines.sparkSession.createDataFrame(
        [(w,) for w in words], "split_word string"
    )
    return (
        expected.join(matched, "split_word", "left")
        .groupBy("split_word")
        .agg(F.count("file").alias("n_files"))
        .filter("n_files <> 1")
    )


def _labelled(rows: DataFrame) -> DataFrame:
    """Integer label and normalised attack, condition and vocoder, where present."""
    out = rows.withColumn("label", L.label_to_int(F.col("label")))
    out = out.withColumn("attack_type", L.norm_attack(F.col("attack"), F.col("label")))
    for name in ("condition", "transmission"):
        if name in out.columns:
            out = out.withColumn(name, L.norm_condition(F.col(name)))
    if "vocoder" in out.columns:
        out = out.withColumn("vocoder", L.norm_vocoder(F.col("vocoder"), F.col("label")))
    return out


def index_protocol_driven(
    dataset_id: str, rows: DataFrame, listing: DataFrame
) -> DataFrame:
    """Protocol rows with their file; files outside the protocol are ignored.

    ``rows`` carries ``split`` next to the protocol fields and ``listing``
    carries ``split`` and ``stem``.
    """
    files = listing.select(
        "split", F.col("stem").alias("utt_id"), F.col("rel").alias("path")
    )
    joined = _labelled(rows).join(files, ["split", "utt_id"])
    return coerce_schema(
        joined.withColumn("dataset_id", F.lit(dataset_id)).withColumn(
            "codec", P.container_codec(F.col("path"))
        )
    )


def index_listing_driven(
    dataset_id: str, listing: DataFrame, keys: DataFrame, split: str = "test"
) -> DataFrame:
    """Files present on disk with their key row; other key rows are ignored."""
    files = listing.select(F.col("stem").alias("utt_id"), F.col("rel").alias("path"))
    joined = files.join(_labelled(keys), "utt_id")
    return coerce_schema(
        joined.withColumn("dataset_id", F.lit(dataset_id))
        .withColumn("split", F.lit(split))
        .withColumn("codec", P.container_codec(F.col("path")))
    )


def index_directory_driven(dataset_id: str, listing: DataFrame) -> DataFrame:
    """Split and label from the first two directories of each relative path."""
    rel = F.col("rel")
    rows = listing.select(
        F.lit(dataset_id).alias("dataset_id"),
        P.utt_id_from_path(rel).alias("utt_id"),
        rel.alias("path"),
        L.lookup(P.path_part(rel, 1), fv.CLASS_DIRS).cast("long").alias("label"),
        L.lookup(P.path_part(rel, 0), fv.SPLIT_DIRS).alias("split"),
        P.container_codec(rel).alias("codec"),
    )
    return coerce_schema(rows.filter(F.col("label").isNotNull() & F.col("split").isNotNull()))


def index_csv_driven(dataset_id: str, index: DataFrame) -> DataFrame:
    """Rows of a CSV index, whose label, split and attack are already resolved."""
    return coerce_schema(
        index.select(
            F.lit(dataset_id).alias("dataset_id"),
            "utt_id",
            "path",
            F.col("label").cast("long").alias("label"),
            "split",
            "attack_type",
            P.container_codec(F.col("path")).alias("codec"),
        )
    )


def _listing(spark: SparkSession, audio: str | DataFrame) -> DataFrame:
    """Listing of a folder, or of a ``path`` table such as a storage inventory.

    The table form keeps very large file sets off the driver.
    """
    if isinstance(audio, str):
        return scan_audio_listing(spark, audio)
    return describe_listing(audio)


class IndexProblem(ValueError):
    """A raw layout that cannot give a complete manifest."""


def _stop_if_any(problems: DataFrame, what: str) -> None:
    example = problems.limit(3).collect()
    if example:
        raise IndexProblem(f"{what}: e.g. {[r.asDict() for r in example]}")


def _checked_rows(
    lines: DataFrame, fields: dict[str, int], key: list[str] | None = None
) -> DataFrame:
    narrow = proto.short_lines(lines, fields)
    if narrow.limit(1).collect():
        bad = proto.with_line_number(lines)
        _stop_if_any(
            proto.short_lines(bad, fields).select("file", "line_no", "n_fields"),
            "protocol lines are too short",
        )
    rows = proto.protocol_fields(lines, fields)
    _stop_if_any(protocol_duplicates(rows, key or ["file", "utt_id"]), "repeated protocol keys")
    return rows


@ADAPTERS.register("protocol_5")
def adapt_protocol_5(
    spark: SparkSession, dataset_id: str, protocol_dir: str, audio_root: str | DataFrame
) -> DataFrame:
    """One 5-field protocol file per split, audio in one folder per split."""
    lines = proto.read_protocol(spark, f"{protocol_dir}/*.txt")
    _stop_if_any(protocol_file_problems(lines), "each split needs exactly one protocol file")
    rows = _checked_rows(lines, fv.PROTOCOL_5_FIELDS)
    rows = rows.withColumn("split", _split_word(P.file_name(F.col("file")))).filter(
        F.col("split").isNotNull()
    )
    listing = _listing(spark, audio_root).withColumn(
        "split", _split_word(P.path_part(F.col("rel"), 0))
    )
    _stop_if_any(
        missing_audio(
            rows, listing.withColumn("utt_id", F.col("stem")), ["split", "utt_id"]
        ).select("split", "utt_id"),
        "protocol rows without audio",
    )
    return index_protocol_driven(dataset_id, rows, listing)


def _split_word(name) -> F.Column:
    out = F.lit(None)
    for word, split in fv.NATIVE_SPLITS.items():
        out = F.when(F.contains(F.lower(name), F.lit(word)), split).otherwise(out)
    return out


def _adapt_keys(spark, dataset_id, keys_path, audio_root, fields) -> DataFrame:
    rows = _checked_rows(proto.read_protocol(spark, keys_path), fields, ["utt_id"])
    listing = _listing(spark, audio_root)
    _stop_if_any(
        unlabelled_audio(
            listing.withColumn("utt_id", F.col("stem")), rows, ["utt_id"]
        ).select("path"),
        "files without a key row",
    )
    return index_listing_driven(dataset_id, listing, rows)


@ADAPTERS.register("keys_8")
def adapt_keys_8(spark, dataset_id: str, keys_path: str, audio_root: str | DataFrame) -> DataFrame:
    """One 8-field key list for a possibly partial download."""
    return _adapt_keys(spark, dataset_id, keys_path, audio_root, fv.KEYS_8_FIELDS)


@ADAPTERS.register("keys_13")
def adapt_keys_13(spark, dataset_id: str, keys_path: str, audio_root: str | DataFrame) -> DataFrame:
    """One 13-field key list for a possibly partial download."""
    return _adapt_keys(spark, dataset_id, keys_path, audio_root, fv.KEYS_13_FIELDS)


@ADAPTERS.register("directories")
def adapt_directories(spark, dataset_id: str, audio_root: str | DataFrame) -> DataFrame:
    """Label and split from directory names only."""
    out = index_directory_driven(dataset_id, _listing(spark, audio_root))
    if not out.limit(1).collect():
        raise IndexProblem(f"no labelled audio below {audio_root}")
    return out


@ADAPTERS.register("csv_index")
def adapt_csv_index(spark, dataset_id: str, index_path: str, audio_root: str | DataFrame) -> DataFrame:
    """A header CSV that names label, split and file of each row."""
    index = scan_csv_index(spark, index_path)
    listing = _listing(spark, audio_root).select(F.col("rel").alias("path"))
    _stop_if_any(
        missing_audio(index, listing, ["path"]).select("path"), "index rows without audio"
    )
    if not index.limit(1).collect():
        raise IndexProblem(f"{index_path} has no rows")
    return index_csv_driven(dataset_id, index)
