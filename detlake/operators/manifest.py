"""Canonical manifest: coercion, selection, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake import fixed_values as fv, schema
from detlake.functions import paths as P
from detlake.functions.numeric import md5_int, nan_to_null
from detlake.session import materialize


class SchemaProblem(ValueError):
    """A table lacks required columns or holds no rows where some are needed."""


def coerce_schema(df: DataFrame) -> DataFrame:
    """Canonical columns in order and type; extra columns go, absent optionals are NULL.

    Casts follow ANSI rules, so a value that does not fit stops the job.
    """
    missing = [c for c in schema.REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaProblem(f"missing required columns: {missing}")
    out = []
    for f in schema.MANIFEST.fields:
        if f.name not in df.columns:
            col = F.lit(None).cast(f.dataType)
        else:
            col = F.col(f.name).cast(f.dataType)
            if f.name == "duration":
                col = nan_to_null(col)
        out.append(col.alias(f.name))
    return df.select(*out)


def union_manifests(frames: list[DataFrame]) -> DataFrame:
    """All rows by column name; repeated rows stay."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


class NoRows(ValueError):
    """A choice that leaves nothing."""


def select_split(
    manifest: DataFrame, selectors: list[tuple[str, str]], strict: bool = True
) -> DataFrame:
    """Rows of the chosen ``(dataset_id, split)`` pairs.

    A pair listed twice gives its rows twice. The predicate is a plain filter on
    the two columns, so it reaches the scan. With ``strict`` a pair without rows
    is an error.
    """
    parts = [
        manifest.filter((F.col("dataset_id") == d) & (F.col("split") == s))
        for d, s in selectors
    ]
    if strict:
        absent = empty_selectors(manifest, selectors)
        if absent:
            raise SchemaProblem(f"selectors without rows: {absent}")
    if len(set(selectors)) < len(selectors):
        return union_manifests(parts)
    wanted = F.lit(False)
    for d, s in selectors:
        wanted = wanted | ((F.col("dataset_id") == d) & (F.col("split") == s))
    return manifest.filter(wanted)


def empty_selectors(
    manifest: DataFrame, selectors: list[tuple[str, str]]
) -> list[tuple[str, str]]:
    """Selectors without rows; the driver gets one row per selector at most."""
    wanted = manifest.sparkSession.createDataFrame(
        sorted(set(selectors)), "dataset_id string, split string"
    )
    found = manifest.select("dataset_id", "split").join(
        F.broadcast(wanted), ["dataset_id", "split"], "left_semi"
    ).distinct().collect()
    have = {tuple(r) for r in found}
    return [s for s in selectors if s not in have]


def filter_conjunctive(df: DataFrame, **equals) -> DataFrame:
    """AND of the equalities that are given; ``None`` means no condition.

    No row left is an error, told by a scan that stops at the first row.
    """
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    if df.isEmpty():
        raise NoRows(f"no row with {({k: v for k, v in equals.items() if v is not None})}")
    return df


def stable_key_sort(df: DataFrame, key: list[str] = schema.KEY) -> DataFrame:
    """Output order only; nothing in the package depends on row order."""
    return df.orderBy(*key)


def first_n(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The ``n`` first rows in an order, chosen without bringing them together.

    Only the order columns are dealt into ranges and counted; one range holds the
    ``n``-th row, and its columns become a filter on ``df``. Rows that are equal in the
    order count by a hash of all their columns; of such that are equal in that too, as many as are left go along.
    """
    if n <= 0:
        return df.limit(0)
    place = F.struct(*order, F.xxhash64(*df.columns).alias("_tie")).alias("_place")
    ranged = df.select(place).repartitionByRange("_place").withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "first_n")
    before, cut = 0, None
    for row in ranged.groupBy("_range").count().orderBy("_range").collect():  # one row per range
        if before + row["count"] >= n:
            cut = row["_range"]
            break
        before += row["count"]
    if cut is None:
        return df
    in_range = Window.partitionBy("_range").orderBy("_place")
    inside = ranged.filter(F.col("_range") == cut).withColumn("_at", F.row_number().over(in_range))
    last = inside.filter(F.col("_at") == n - before).select(F.col("_place").alias("_last"))
    last = materialize(last, "first_n_last")  # one row
    below = before + inside.join(F.broadcast(last)).filter(F.col("_place") < F.col("_last")).count()
    placed = df.withColumn("_place", place).join(F.broadcast(last))
    rest = placed.filter(F.col("_place") == F.col("_last")).limit(n - below)
    return placed.filter(F.col("_place") < F.col("_last")).unionByName(rest).select(*df.columns)


def limit_first_n(df: DataFrame, n: int, key: list[str] = schema.KEY) -> DataFrame:
    """First ``n`` rows by key, in key order."""
    return first_n(df, n, [F.col(c) for c in key]).orderBy(*key)


def seeded_sample_n(
    df: DataFrame, n: int, seed: int = fv.DEFAULT_SEED, key: list[str] = schema.KEY
) -> DataFrame:
    """``n`` rows without replacement by hashed key, returned in key order."""
    draw = F.md5(F.concat_ws(",", F.lit(str(seed)), *key)).alias("_draw")
    return first_n(df, n, [draw, *[F.col(c) for c in key]]).orderBy(*key)


def domain_except(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Distinct non-null values outside ``allowed``."""
    col = F.col(column)
    return df.filter(col.isNotNull() & ~col.isin(allowed)).select(column).distinct()


def sentinel_intersect(df: DataFrame, column: str) -> DataFrame:
    """Distinct lower-cased values that are placeholders."""
    value = F.lower(F.col(column))
    return (
        df.filter(value.isin(fv.ATTACK_SENTINELS)).select(value.alias(column)).distinct()
    )


def dedupe_keys(df: DataFrame, key: list[str] = schema.KEY) -> DataFrame:
    return df.select(*key).distinct()


# --- small balanced dataset --------------------------------------------------

def first_k_per_class(manifest: DataFrame, k: int = fv.MINI_PER_CLASS) -> DataFrame:
    """First ``k`` rows of each class by ``utt_id``, from datasets that fill both.

    The rank filter is pushed below the shuffle, so a task forwards at most ``k``
    rows per dataset and class.
    """
    order = Window.partitionBy("dataset_id", "label").orderBy("utt_id")
    top = (
        manifest.filter(F.col("label").isin(fv.LABEL_BONAFIDE, fv.LABEL_SPOOF))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )
    both = Window.partitionBy("dataset_id")
    return (
        top.withColumn("_n", F.count("*").over(both))
        .filter(F.col("_n") == 2 * k)
        .drop("_n")
    )


def skipped_sources(manifest: DataFrame, k: int = fv.MINI_PER_CLASS) -> DataFrame:
    """Datasets too small for :func:`first_k_per_class`, with their class counts."""
    return (
        manifest.groupBy("dataset_id")
        .agg(
            F.count_if(F.col("label") == fv.LABEL_BONAFIDE).alias("n_bonafide"),
            F.count_if(F.col("label") == fv.LABEL_SPOOF).alias("n_spoof"),
        )
        .filter((F.col("n_bonafide") < k) | (F.col("n_spoof") < k))
    )


def split_by_rank_quota(rank, quota: dict[str, int] = fv.MINI_SPLIT_QUOTA):
    """Split of a class rank: each split takes its quota in turn, the rest is train."""
    out = F.when(F.lit(False), "train")
    upto = 0
    for split, n in quota.items():
        upto += n
        out = out.when(rank <= upto, split)
    return out.otherwise("train")


def sources_without_audio(picked: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources of which a picked row has no file in ``listing`` (``path``): ``dataset_id, reason``."""
    gone = picked.join(listing.select("path").distinct(), "path", "left_anti")
    reason = F.concat(F.lit("no audio: "), F.min("path"))
    return gone.groupBy("dataset_id").agg(reason.alias("reason"))


def mini_dataset(
    manifest: DataFrame, k: int = fv.MINI_PER_CLASS, listing: DataFrame | None = None
) -> DataFrame:
    """Index of a small balanced dataset drawn from every source.

    With a ``listing`` of the files that are there, a source that lacks the audio of a
    picked row is skipped whole; :func:`sources_without_audio` gives the reasons.
    """
    picked = first_k_per_class(manifest, k)
    if listing is not None:
        gone = sources_without_audio(picked, listing)
        picked = picked.join(gone.select("dataset_id"), "dataset_id", "left_anti")
    ds, utt = F.col("dataset_id"), F.col("utt_id")
    return picked.select(
        P.namespaced_utt(ds, utt).alias("utt_id"),
        P.namespaced_path(ds, utt, F.col("path")).alias("path"),
        "label",
        split_by_rank_quota(F.col("rank")).alias("split"),
        ds.alias("source_dataset_id"),
        utt.alias("source_utt_id"),
        "attack_type",
    ).orderBy("utt_id")
