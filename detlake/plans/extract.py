"""Bulk feature extraction: one utterance is one unit of work.

A recipe (:mod:`detlake.functions.recipes`) has one registered name and a
``feature_id`` made from its written form, so tables of different recipes never mix.
The feature table has a row per frame. A failed utterance is one row with ``error`` in the
``status=failed`` folder of the same table, written by the same job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from detlake import fixed_values as fv, schema
from detlake.functions import recipes
from detlake.functions.recipes import Recipe
from detlake.operators.resume import latest_wins, run_stats, todo_by_key
from detlake.plans import finished
from detlake.registry import Registry
from detlake.session import broadcast_if_small, materialize, ship_package

EXTRACTORS = Registry("extractor")
EXTRACTORS.add("logmel", recipes.logmel("logmel", fv.LOGMEL_PARAMS))
EXTRACTORS.add("lfcc", recipes.lfcc("lfcc", fv.LFCC_PARAMS))
BATCH_FRAMES = 4096  # frames sent back from a worker at a time
TODO_ROWS = 1_000_000  # keys that may be broadcast to a waveform scan


def get_extractor(name: str) -> Recipe:
    """The one recipe behind a name; variants get names of their own."""
    return EXTRACTORS.get(name)


def checked(m: np.ndarray, channels: int) -> np.ndarray:
    """A matrix as it will be stored, after the contract: two axes, declared width, finite."""
    if m.ndim != 2 or m.shape[1] != channels:
        raise ValueError(f"shape {m.shape}, expected [T, {channels}]")
    if not np.isfinite(m).all():
        raise ValueError("NaN or Inf in features")
    return m


def frames_schema(double: bool = False) -> T.StructType:
    number = T.DoubleType() if double else T.FloatType()
    return T.StructType([
        T.StructField("dataset_id", T.StringType()),
        T.StructField("utt_id", T.StringType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("n_frames", T.IntegerType()),
        T.StructField("coeffs", T.ArrayType(number)),
        T.StructField("error", T.StringType()),
    ])


def extract(waves: DataFrame, extractor: Recipe, double: bool = False) -> DataFrame:
    """Frame rows of every waveform; a failure is one row with ``error``.

    ``waves`` has ``dataset_id, utt_id, sr, samples`` and may carry an ``error``
    from decoding, which is passed on. One utterance is in memory at a time.
    """
    number = pa.float64() if double else pa.float32()
    kind = np.float64 if double else np.float32
    out_schema = pa.schema([
        ("dataset_id", pa.string()), ("utt_id", pa.string()), ("frame", pa.int32()),
        ("n_frames", pa.int32()), ("coeffs", pa.list_(number)), ("error", pa.string()),
    ])

    def matrix(sr, samples, error) -> np.ndarray:
        if error is not None:
            raise RuntimeError(error)
        if sr != extractor.rate:
            raise ValueError(f"sample rate {sr}, expected {extractor.rate}")
        with np.errstate(over="ignore"):
            stored = np.ascontiguousarray(extractor.matrix(samples), kind)
        return checked(stored, extractor.channels)

    def frame_rows(ds, utt, m: np.ndarray) -> pa.RecordBatch:
        t, c = m.shape
        ends = pa.array(np.arange(0, t * c + 1, c, dtype=np.int32))
        return pa.RecordBatch.from_arrays([
            pa.repeat(pa.scalar(ds, pa.string()), t), pa.repeat(pa.scalar(utt, pa.string()), t),
            pa.array(np.arange(t, dtype=np.int32)), pa.array(np.full(t, t, np.int32)),
            pa.ListArray.from_arrays(ends, pa.array(m.reshape(-1), number)),
            pa.nulls(t, pa.string()),
        ], schema=out_schema)

    def failed_row(ds, utt, text: str) -> pa.RecordBatch:
        values = [[ds], [utt], [None], [None], [None], [text]]
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(values, out_schema)], schema=out_schema
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, rows = [], 0
            for i in range(batch.num_rows):
                ds, utt, sr, _, error = (
                    batch.column(j)[i].as_py() if j != 3 else None for j in range(5)
                )
                signal = batch.column(3)[i]
                try:
                    samples = signal.values.to_numpy(zero_copy_only=False) if signal.is_valid else None
                    ready.append(frame_rows(ds, utt, matrix(sr, samples, error)))
                except Exception as e:  # one bad utterance is one failed row
                    ready.append(failed_row(ds, utt, error or f"{type(e).__name__}: {e}"))
                rows += ready[-1].num_rows
                if rows >= BATCH_FRAMES:
                    yield _joined(ready)
                    ready, rows = [], 0
            if ready:
                yield _joined(ready)

    ship_package(waves.sparkSession)
    if "error" not in waves.columns:
        waves = waves.withColumn("error", F.lit(None).cast("string"))
    return waves.select(*schema.KEY, "sr", "samples", "error").mapInArrow(
        run, frames_schema(double)
    )


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    (one,) = pa.Table.from_batches(batches).combine_chunks().to_batches()
    return one


def extracted(frames: DataFrame) -> DataFrame:
    """The frames of the utterances that worked."""
    return frames.filter(F.col("error").isNull())


# --- the feature table -------------------------------------------------------

def table_schema() -> T.StructType:
    return T.StructType(
        [f for f in frames_schema().fields if f.name != "dataset_id"]
        + [
            T.StructField("attempt", T.LongType()),
            T.StructField("partial", T.BooleanType()),
            T.StructField("recipe", T.StringType()),
            T.StructField("channels", T.IntegerType()),
            T.StructField("feature_id", T.StringType()),
            T.StructField("dataset_id", T.StringType()),
            T.StructField("status", T.StringType()),
        ]
    )


def read_table(spark: SparkSession, root: str) -> DataFrame:
    """The feature table, empty before the first run."""
    try:
        return spark.read.schema(table_schema()).parquet(root)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], table_schema())
        raise


def specs(table: DataFrame) -> DataFrame:
    """What was built: ``feature_id, channels, recipe`` of every recipe that was ever run."""
    return table.filter(F.col("status") == "run").select("feature_id", "channels", "recipe").distinct()


def _finished(table: DataFrame, feature_id: str) -> DataFrame:
    return table.filter(
        (F.col("feature_id") == feature_id) & (F.col("status") == "ok") & (F.col("frame") == 0)
    ).select(*schema.KEY, "attempt")


def done_keys(table: DataFrame, feature_id: str) -> DataFrame:
    """Finished utterances: the scan reads first frames and no coefficients."""
    return _finished(table, feature_id).select(*schema.KEY)


def failures(table: DataFrame, feature_id: str) -> DataFrame:
    """Current failure log: the last full run's failures and partial ones after it.

    Every run leaves one row per dataset it was asked for, so a full run without
    failures clears the log. A key that a later run finished has left it too.
    """
    mine = table.filter(F.col("feature_id") == feature_id)
    bad = mine.filter(F.col("status") == "failed").select(
        *schema.KEY, "error", "attempt", "partial"
    )
    runs = mine.filter((F.col("status") == "run") & ~F.col("partial"))
    full = runs.groupBy("dataset_id").agg(F.max("attempt").alias("last_full"))
    current = (
        bad.join(full, "dataset_id", "left")
        .filter(F.col("attempt") >= F.coalesce(F.col("last_full"), F.lit(0)))
        .drop("last_full", "partial")
    )
    latest = latest_wins(current, schema.KEY, ["attempt"])
    return todo_by_key(latest, done_keys(table, feature_id)).drop("attempt")


def extract_features(
    waves: DataFrame, extractor: Recipe, root: str, limit: int | None = None,
    attempt: int | None = None,
) -> DataFrame:
    """Extract what is missing into the feature table and return the run's counts.

    Only keys without frames are processed, so a rerun resumes; which of them are finished is
    read from an index (:mod:`detlake.plans.finished`), in proportion to what is asked. ``limit`` takes
    the first keys in order and marks the run as partial. ``attempt`` numbers the run
    where the caller counts them. One write stores
    frames and failures; a lost executor repeats only its own tasks.
    """
    spark = waves.sparkSession
    table = read_table(spark, root)
    known = finished.marks(spark, root, extractor.feature_id)
    if attempt is None:
        attempt = (table.filter(F.col("status") == "run").agg(F.max("attempt")).first()[0] or 0) + 1
        attempt = max([attempt, *(a + 1 for a in known)])
    asked, n_skipped = waves, None
    if limit is not None:
        first = waves.select(*schema.KEY).orderBy(*schema.KEY).limit(limit)
        asked = waves.join(broadcast_if_small(first), schema.KEY, "left_semi")
    if attempt > 1 or known:
        done = finished.among(
            asked.select(*schema.KEY), _finished(table, extractor.feature_id), root, extractor.feature_id, known)
        skipped = asked.select(*schema.KEY).join(done, schema.KEY, "left_semi")
        n_skipped = materialize(
            skipped.groupBy("dataset_id").agg(F.count("*").alias("n")), "skipped"
        )
        asked = _without_done(asked, done)
    out = extract(asked, extractor).select(
        "*",
        F.lit(attempt).cast("long").alias("attempt"),
        F.lit(limit is not None).alias("partial"),
        F.lit(extractor.feature_id).alias("feature_id"),
        F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"),
    )
    finished.begin(spark, root, extractor.feature_id, attempt)
    write_features(out, root)
    asked_of = waves.select("dataset_id").distinct().select(
        "dataset_id", F.lit(attempt).cast("long").alias("attempt"), F.lit(limit is not None).alias("partial"),
        F.lit(extractor.text).alias("recipe"), F.lit(extractor.channels).alias("channels"),
        F.lit(extractor.feature_id).alias("feature_id"), F.lit("run").alias("status"))
    write_features(asked_of, root)
    finished.settle(
        _finished(read_table(spark, root), extractor.feature_id), root, extractor.feature_id, attempt, known)
    after = read_table(spark, root).filter(
        (F.col("feature_id") == extractor.feature_id) & (F.col("attempt") == attempt)
    )
    outcome = after.filter((F.col("frame") == 0) | (F.col("status") == "failed")).select(
        *schema.KEY, "status"
    )
    counted = run_stats(outcome)
    before = n_skipped
    if before is None:
        before = spark.createDataFrame([], "dataset_id string, n long")
    merged = counted.drop("ok").join(before, "dataset_id", "full").na.fill(0)
    return merged.select(
        "dataset_id",
        (F.col("total") + F.col("n")).alias("total"), "written",
        (F.col("skipped") + F.col("n")).alias("skipped"), "failed",
        (F.col("written") + F.col("n") > 0).alias("ok"),
    )


def _without_done(waves: DataFrame, done: DataFrame) -> DataFrame:
    """Waveforms whose key is not done, moving signals only as a last resort.

    The keys alone decide what is left. Whichever is short, what is left or what
    is done, is broadcast to the signals; only when both are long are the signals
    shuffled.
    """
    left = materialize(todo_by_key(waves.select(*schema.KEY), done), "todo")
    short = broadcast_if_small(left, TODO_ROWS)
    if short is not left:
        return waves.join(short, schema.KEY, "left_semi")
    return todo_by_key(waves, broadcast_if_small(done, TODO_ROWS))


def write_features(frames: DataFrame, root: str) -> None:
    """Append to the table, partitioned by parameter set, dataset and status.

    The rebalance hint evens out file sizes and splits a dataset that holds most
    of the rows.
    """
    parts = ["feature_id", "dataset_id", "status"]
    frames.hint("rebalance", *parts).write.mode("append").partitionBy(*parts).parquet(root)
