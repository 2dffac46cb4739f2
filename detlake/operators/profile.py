"""Composition and column statistics of a manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from detlake import fixed_values as fv, schema


def _bonafide():
    return F.col("label") == fv.LABEL_BONAFIDE


def _spoof():
    return F.col("label") == fv.LABEL_SPOOF


def class_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """``bonafide``, ``spoof`` and ``total`` per group; an absent class is 0."""
    return df.groupBy(*keys).agg(
        F.count_if(_bonafide()).alias("bonafide"),
        F.count_if(_spoof()).alias("spoof"),
        F.count_if(_bonafide() | _spoof()).alias("total"),
    )


def class_balance(df: DataFrame) -> DataFrame:
    return class_counts(df, ["split"])


def class_balance_by_dataset(df: DataFrame) -> DataFrame:
    return class_counts(df, ["dataset_id"])


def split_composition(df: DataFrame) -> DataFrame:
    return class_counts(df, ["dataset_id", "split"])


def composition_table(df: DataFrame) -> DataFrame:
    """Dataset and split by class, with the spoof percentage to one place."""
    pct = 100.0 * F.col("spoof") / F.nullif(F.col("total"), F.lit(0))
    return split_composition(df).withColumn("spoof_pct", F.bround(pct, 1))


def attack_counts(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Rows per attack inside each dataset (attack names are local to one).

    A table without any attack is an error.
    """
    if dataset_id is not None:
        df = df.filter(F.col("dataset_id") == dataset_id)
    named = df.filter(F.col("attack_type").isNotNull())
    if named.isEmpty():
        raise ValueError(f"no attack types in {dataset_id or 'the manifest'}")
    return (
        named
        .groupBy("dataset_id", "attack_type")
        .agg(F.count("*").alias("n_rows"))
        .orderBy("dataset_id", "attack_type")
    )


def _long_values(df: DataFrame, keys: list[str]) -> DataFrame:
    """Optional columns as ``(column, value)`` rows; NULL values are left out."""
    cols = [c for c in schema.OPTIONAL_COLUMNS if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols
    ])
    return df.select(*keys, F.inline(pairs)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows per value of each optional column, combined before the shuffle."""
    keys = keys or []
    return _long_values(df, keys).groupBy(*keys, "column", "value").agg(
        F.count("*").alias("n_rows")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """``non_null`` and ``n_unique`` of every optional column.

    Distinct values are counted from the value counts, so a column with few
    values costs few shuffled rows and no task holds a set of values.
    """
    counted = value_counts(df).groupBy("column").agg(
        F.sum("n_rows").alias("non_null"), F.count("*").alias("n_unique")
    )
    columns = df.sparkSession.createDataFrame(
        [(c,) for c in schema.OPTIONAL_COLUMNS if c in df.columns], "column string"
    )
    return columns.join(counted, "column", "left").na.fill(0, ["non_null", "n_unique"])


def column_profile_approx(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Same table in one pass with an approximate distinct count."""
    cols = [c for c in schema.OPTIONAL_COLUMNS if c in df.columns]
    stats = df.agg(*[
        F.struct(
            F.count(c).alias("non_null"),
            F.approx_count_distinct(c, rsd).alias("n_unique"),
        ).alias(c)
        for c in cols
    ])
    return stats.unpivot([], cols, "column", "s").select("column", "s.*")


def value_counts_capped(
    df: DataFrame, limit: int = fv.VALUE_COUNT_LIMIT
) -> DataFrame:
    """Value counts of the columns with 1 to ``limit`` distinct values.

    A column drops out whole, as soon as it has one value too many. The list of
    columns that stay has at most one row per optional column.
    """
    counts = value_counts(df)
    few = counts.groupBy("column").agg(F.count("*").alias("n_unique")).filter(
        F.col("n_unique") <= limit
    )
    return counts.join(F.broadcast(few.select("column")), "column", "left_semi")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-independent content hash: row count and the sums of two words of 60 bits of the rows' md5.

    The words are added as decimals, so the sums are exact; any engine with md5 can repeat it.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in df.columns]
    row = F.md5(F.concat_ws("\x1f", *cols))
    word = lambda i: F.conv(F.substring("h", 15 * i + 1, 15), 16, 10).cast("bigint").cast("decimal(19,0)")
    sums = [F.coalesce(F.sum(word(i)), F.lit(0)).cast("string") for i in range(2)]
    return df.select(row.alias("h")).agg(
        F.count("*").alias("n_rows"), F.md5(F.concat_ws(",", F.count("*").cast("string"), *sums)).alias("fingerprint"))


def pos_weight(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``N_neg / N_pos`` of the rows given; NULL when a class is absent."""
    neg, pos = F.count_if(_bonafide()), F.count_if(_spoof())
    return df.groupBy(*(keys or [])).agg(
        F.when((neg > 0) & (pos > 0), neg / F.nullif(pos, F.lit(0))).alias("pos_weight")
    )


def dataset_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_id").agg(
        F.count("*").alias("n"),
        F.count_if(_bonafide()).alias("n_bonafide"),
        F.count_if(_spoof()).alias("n_spoof"),
        F.count_if(_spoof() & F.col("attack_type").isNull()).alias(
            "n_spoof_without_attack_type"
        ),
    )


# --- durations ---------------------------------------------------------------

def frame_counts(frames: DataFrame, keys: list[str] = schema.KEY) -> DataFrame:
    """Frames per utterance."""
    return frames.groupBy(*keys).agg(F.count("*").alias("n_frames"))


def _lengths(counts: DataFrame) -> DataFrame:
    """How many utterances have each length: one row per distinct length."""
    return counts.groupBy("dataset_id", "n_frames").agg(F.count("*").alias("n"))


def duration_stats(
    counts: DataFrame, hop: int, sr: int, t_fixed: int = fv.DEFAULT_T_FIXED
) -> DataFrame:
    """Median, p05, p95 in seconds and the share shorter than ``t_fixed``.

    Percentiles are exact and work on length counts, which stay as few as there
    are distinct lengths.
    """
    sec = F.col("n_frames") * F.lit(float(hop)) / F.lit(float(sr))
    p = lambda q: F.percentile(sec, q, F.col("n"))
    short = F.sum(F.when(F.col("n_frames") < t_fixed, F.col("n")).otherwise(0))
    return _lengths(counts).groupBy("dataset_id").agg(
        F.sum("n").alias("n"),
        F.bround(p(0.5), 2).alias("median_sec"),
        F.bround(p(0.05), 2).alias("p05_sec"),
        F.bround(p(0.95), 2).alias("p95_sec"),
        F.bround(100.0 * short / F.sum("n"), 1).alias("pct_shorter"),
    )


def duration_histogram(counts: DataFrame, hop: int, sr: int, bins: int = 60) -> DataFrame:
    """Density over equal bins from min to max per dataset; the last bin is closed.

    Empty bins are included. With all lengths equal the range is one second
    around the value, as plotting libraries take it.
    """
    sec = F.col("n_frames") * F.lit(float(hop)) / F.lit(float(sr))
    lengths = _lengths(counts).withColumn("sec", sec)
    spans = lengths.groupBy("dataset_id").agg(
        F.min("sec").alias("lo"), F.max("sec").alias("hi"), F.sum("n").alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    spans = spans.select(
        "dataset_id", "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )
    at = F.floor((F.col("sec") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)
    hits = (
        lengths.join(spans, "dataset_id")
        .withColumn("bin", F.least(at, F.lit(bins - 1)).cast("int"))
        .groupBy("dataset_id", "bin")
        .agg(F.sum("n").alias("n"))
    )
    grid = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("hi") - F.col("lo")) / bins
    return (
        grid.join(hits, ["dataset_id", "bin"], "left")
        .na.fill(0, ["n"])
        .select(
            "dataset_id", "bin", (F.col("lo") + F.col("bin") * width).alias("left_sec"),
            "n", (F.col("n") / (F.col("total") * width)).alias("density"),
        )
    )
