"""PCM WAV decoding: files or binary rows to mono float samples, faults to error rows."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from detlake import schema
from detlake.functions.paths import plain_path, relative_to
from detlake.operators import prefix
from detlake.session import broadcast_if_small, materialize, ship_package
from detlake.sources.files import add_lengths, open_root, reachable

BUNDLE = 128 << 20   # bytes a task reads
OPENING = 256 << 10  # what opening a file counts for
UNSIZED = 1 << 20    # bytes a file of a listing without lengths counts for
HELD = 8 << 20       # bytes of files decoded before rows are sent on
MISSING = "FileNotFoundError: no audio file"

_DECODED = T.StructType([
    T.StructField("sr", T.IntegerType()),
    T.StructField("samples", T.ArrayType(T.FloatType())),
    T.StructField("error", T.StringType()),
])


def pcm_to_mono(raw: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono float32 signal of one PCM WAV file."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float64) - 128.0) / 128.0
    elif width == 2:
        x = np.frombuffer(data, "<i2").astype(np.float64) / 2.0 ** 15
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        x = np.where(v >= 1 << 23, v - (1 << 24), v) / 2.0 ** 23
    elif width == 4:
        x = np.frombuffer(data, "<i4").astype(np.float64) / 2.0 ** 31
    else:
        raise ValueError(f"unsupported sample width {width}")
    return rate, x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def _decoded(raw: bytes, target_sr: int) -> tuple[int | None, np.ndarray | None, str | None]:
    """Rate, samples and error of one file; a fault of the file is a row, not an exception."""
    try:
        rate, x = pcm_to_mono(raw)
        if rate != target_sr:
            raise ValueError(f"sample rate {rate}, expected {target_sr}")
        if not len(x):
            raise ValueError("no samples")
        return rate, x, None
    except Exception as e:
        return None, None, f"{type(e).__name__}: {e}"


def decode_wav(files: DataFrame, target_sr: int) -> DataFrame:
    """Add ``sr``, ``samples``, ``error`` to rows with a binary ``content``.

    A file that cannot be decoded, is empty or has another sample rate gets an
    ``error`` and no samples; no row is dropped. Every file is decoded once, whatever
    is filtered on afterwards.
    """

    ship_package(files.sparkSession)

    @F.pandas_udf(_DECODED)
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield pd.DataFrame([_decoded(raw, target_sr) for raw in contents], columns=_DECODED.names)

    # A filter on the result would be pushed below a deterministic function, with a second copy of
    # it and of all Python that makes the content: twice the work and twice the Python workers.
    decode = decode.asNondeterministic()
    return (
        files.withColumn("_d", decode("content"))
        .drop("content")
        .select("*", "_d.*")
        .drop("_d")
    )


def _read_and_decode(root: str, target_sr: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_root(root)
        for batch in batches:
            rows, held, first = [], 0, 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                raw = b""
                try:
                    with store.open_input_stream(f"{base}/{path}", compression=None) as f:
                        raw = f.read()
                    rows.append((*_decoded(raw, target_sr), len(raw)))
                except FileNotFoundError:  # gone since it was sized; other faults of the store fail the task
                    rows.append((None, None, MISSING, 0))
                held += len(raw)
                if held >= HELD or i == len(batch) - 1:
                    sr, samples, error, size = zip(*rows)
                    yield pa.RecordBatch.from_arrays([
                        *(batch.column(c).slice(first, len(rows)) for c in (*schema.KEY, "path")), pa.array(sr, pa.int32()),
                        pa.array(samples, pa.list_(pa.float32())), pa.array(error, pa.string()), pa.array(size, pa.int64())],
                        [*schema.KEY, "path", "sr", "samples", "error", "n_bytes"])
                    rows, held, first = [], 0, i + 1

    return run


def _bundled(sized: DataFrame) -> DataFrame:
    """The files in bundles of about ``BUNDLE`` bytes, one partition each, neighbours in one."""
    cost = sized.withColumn("cost", F.col("length") + OPENING)
    summed = prefix.running_totals(cost, [], "path", ["cost"])
    packed = materialize(summed.withColumn("bundle", F.floor((F.col("cum_cost") - 1) / BUNDLE).cast("int")), "ingest-bundles")
    last = packed.agg(F.max("bundle")).first()[0]
    return packed.select(*schema.KEY, "path", "bundle").repartitionById((last or 0) + 1, "bundle").drop("bundle")


def waveform_ingest(
    spark: SparkSession, manifest: DataFrame, raw_root: str, target_sr: int,
    done: DataFrame | None = None, listing: DataFrame | None = None,
) -> DataFrame:
    """Waveform rows of the manifest's files, each read by its own path and decoded where it is read.

    Keys and paths decide what is read: rows whose key is in ``done`` are left out
    first, the rest is sized (by the store, or by a ``listing`` with relative ``path`` and
    ``length``, such as a storage inventory), packed into bundles of equal bytes, and every bundle is one
    task that opens its files one after the other. Neither content nor samples are
    shuffled, and no other file below ``raw_root`` is touched. ``n_bytes`` is what was
    read. Manifest rows without a file come back with an ``error``.

    A store that only Spark's readers can open is scanned by them and joined by path.
    """
    wanted = manifest.select(*schema.KEY, "path")
    if done is not None:
        wanted = wanted.join(done.select(*schema.KEY).distinct(), schema.KEY, "left_anti")
    if not reachable(raw_root):
        return _scan_and_decode(spark, materialize(wanted, "ingest-wanted"), raw_root, target_sr, listing)
    ship_package(spark)
    if listing is None:
        sized = add_lengths(wanted, raw_root)
    else:
        length = F.max("length") if "length" in listing.columns else F.max(F.lit(UNSIZED))
        sized = wanted.join(listing.groupBy("path").agg(length.cast("long").alias("length")), "path", "left")
    sized = materialize(sized.select(*schema.KEY, "path", "length"), "ingest-sized")
    kinds = ", ".join(f"{c} {sized.schema[c].dataType.simpleString()}" for c in (*schema.KEY, "path"))
    decoded = _bundled(sized.filter("length is not null")).mapInArrow(
        _read_and_decode(raw_root, target_sr), f"{kinds}, sr int, samples array<float>, error string, n_bytes bigint")
    return decoded.unionByName(_without_file(sized.filter("length is null"), decoded))


def _without_file(rows: DataFrame, decoded: DataFrame) -> DataFrame:
    empty = {"error": F.lit(MISSING), "n_bytes": F.lit(0).cast("long")}
    return rows.select(*schema.KEY, "path", *[
        empty.get(c, F.lit(None).cast(decoded.schema[c].dataType)).alias(c) for c in ("sr", "samples", "error", "n_bytes")])


def _scan_and_decode(
    spark: SparkSession, wanted: DataFrame, raw_root: str, target_sr: int, listing: DataFrame | None
) -> DataFrame:
    """Every file below the root scanned by Spark, joined with the wanted paths and decoded last."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(raw_root)
        .withColumn("path", relative_to(plain_path(F.col("path")), raw_root))
    )
    content = files.select("path", "content").join(broadcast_if_small(wanted), "path")
    content = content.withColumn("n_bytes", F.length("content").cast("long"))
    decoded = decode_wav(content, target_sr).select(*schema.KEY, "path", "sr", "samples", "error", "n_bytes")
    known = (listing if listing is not None else files).select("path").distinct()
    return decoded.unionByName(_without_file(wanted.join(known, "path", "left_anti"), decoded))
