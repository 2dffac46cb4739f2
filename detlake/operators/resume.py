"""Resume by key: what is left to do, what wins, what failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from detlake import schema
from detlake.session import materialize


def todo_by_key(df: DataFrame, done: DataFrame, key: list[str] = schema.KEY) -> DataFrame:
    """Rows whose key is not finished yet."""
    return df.join(done.select(*key), key, "left_anti")


def present_in_cache(
    manifest: DataFrame, features: DataFrame, key: list[str] = schema.KEY
) -> DataFrame:
    """Manifest rows that have features."""
    return manifest.join(features.select(*key), key, "left_semi")


class NothingPresent(ValueError):
    """None of the rows asked for has features."""


def present_or_stop(
    manifest: DataFrame, features: DataFrame, key: list[str] = schema.KEY
) -> tuple[DataFrame, int]:
    """:func:`present_in_cache`, and how many rows are missing; none present is an error."""
    marked = manifest.join(features.select(*key).distinct().withColumn("_has", F.lit(True)), key, "left")
    marked = materialize(marked, "present")
    n = marked.agg(F.count("*").alias("n"), F.count("_has").alias("has")).first()
    if not n["has"]:
        raise NothingPresent(f"none of {n['n']} rows has features")
    return marked.filter("_has").drop("_has"), n["n"] - n["has"]


def latest_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last record per key by ``order``.

    An aggregate rather than a window: each task keeps one record per key before
    the shuffle, so a key that repeats without end stays cheap.
    """
    rest = [c for c in df.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("_r")).select(
        *[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns]
    )


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First record per key by ``order``."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(first.alias("_r")).select(
        *[F.col(c) if c in key else F.col(f"_r.{c}").alias(c) for c in df.columns]
    )


def deadletter_merge(
    old: DataFrame, new: DataFrame, partial: bool, key: list[str] = schema.KEY
) -> DataFrame:
    """Failure log after a run.

    A full run saw every row, so its failures are the log. A partial run adds to
    the log and the newer record of a key wins.
    """
    if not partial:
        return new
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    return latest_wins(both, key, ["_seq"]).drop("_seq")


def attach_scores(
    manifest: DataFrame, scores: DataFrame, key: list[str] = schema.KEY
) -> DataFrame:
    """Manifest rows with their score, in the fixed column order."""
    return manifest.join(scores.select(*key, "score"), key).select(*schema.SCORE_COLUMNS)


def coverage_stats(requested: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: ``n_requested``, ``n_scored``, ``ratio`` to six places."""
    a = requested.agg(F.count("*").alias("n_requested"), F.lit(0).alias("n_scored"))
    b = scored.agg(F.lit(0).alias("n_requested"), F.count("*").alias("n_scored"))
    ratio = F.coalesce(
        F.col("n_scored") / F.nullif(F.col("n_requested"), F.lit(0)), F.lit(0.0)
    )
    return (
        a.unionByName(b)
        .agg(
            F.sum("n_requested").alias("n_requested"), F.sum("n_scored").alias("n_scored")
        )
        .withColumn("ratio", F.bround(ratio, 6))
    )


def coverage_gate(stats: DataFrame, min_coverage: float) -> DataFrame:
    """Add ``passed``; the unrounded ratio decides."""
    exact = F.coalesce(
        F.col("n_scored") / F.nullif(F.col("n_requested"), F.lit(0)), F.lit(0.0)
    )
    return stats.withColumn("passed", exact >= min_coverage)


def run_stats(attempts: DataFrame) -> DataFrame:
    """Counts per dataset from rows with ``status`` in done / ok / failed.

    A run is broken only when it had rows and none of them succeeded.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    return attempts.groupBy("dataset_id").agg(
        F.count("*").alias("total"),
        count("ok").alias("written"),
        count("done").alias("skipped"),
        count("failed").alias("failed"),
        (count("ok") + count("done") > 0).alias("ok"),
    )


def top_failures(failures: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` failures of each dataset by key."""
    order = Window.partitionBy("dataset_id").orderBy("utt_id")
    return (
        failures.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    )


def best_epoch(history: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """First epoch with the least ``val_eer``; NULL metrics never win."""
    valid = history.filter(F.col("val_eer").isNotNull())
    best = F.min_by("epoch", F.struct("val_eer", "epoch")).alias("epoch")
    low = F.min("val_eer").alias("val_eer")
    return valid.groupBy(*(keys or [])).agg(best, low)


def running_best(history: DataFrame, keys: list[str]) -> DataFrame:
    """Best ``val_eer`` so far per epoch and whether the epoch strictly improved it.

    A history has one row per epoch of one run, so a run fits one window.
    """
    before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    upto = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(
        Window.unboundedPreceding, 0
    )
    prior = F.min("val_eer").over(before)
    improved = F.col("val_eer").isNotNull() & (prior.isNull() | (F.col("val_eer") < prior))
    return history.withColumn("best_so_far", F.min("val_eer").over(upto)).withColumn(
        "improved", improved
    )


def history_truncate(history: DataFrame, last_epoch: int) -> DataFrame:
    """Records up to ``last_epoch``; a record without an epoch stays."""
    return history.filter(F.coalesce(F.col("epoch"), F.lit(-1)) <= last_epoch)


def threshold_by_epoch(
    history: DataFrame, wanted: DataFrame, keys: list[str], order: list[str],
    first: bool = False,
) -> DataFrame:
    """Validation threshold of the wanted epoch of each run.

    A repeated epoch takes its last record, as a resumed run means it, or its
    first with ``first=True``.
    """
    pick = first_wins if first else latest_wins
    rows = history.join(wanted.select(*keys, "epoch"), [*keys, "epoch"], "left_semi")
    return pick(rows, [*keys, "epoch"], order).select(*keys, "epoch", "val_threshold")
