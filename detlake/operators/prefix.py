"""Running totals over a whole group without putting the group on one task.

A plain window over ``dataset_id`` sorts each dataset in one task. Here the
table is range-partitioned by group and value instead, written once, and every
partition's number is kept as its range: Spark's sampled bounds balance the
ranges whatever the values are (infinities, outliers, one hot group), and their
number is ``spark.sql.shuffle.partitions``, so it grows with the cluster and not
with a setting here. Totals per group and range are a small table, become offsets,
and each range then runs its own window.

Rows that are equal in the order columns are always in one range; tables with
heavy ties are reduced to one row per value first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake.session import materialize

RANGE = ["_range"]


def with_ranges(
    df: DataFrame, keys: list[str], value: str, descending: bool = False,
    ties: list[str] = (), name: str = "ranges",
) -> DataFrame:
    """``df`` written once, with ``_range``: its order within a group follows the value.

    The ranges are fixed by the write, so a retried task and every later pass see
    the same ones.
    """
    order = F.col(value).desc() if descending else F.col(value)
    split = df.repartitionByRange(*keys, order, *ties)
    return materialize(split.withColumn("_range", F.spark_partition_id()), name)


def range_totals(
    ranged: DataFrame, keys: list[str], sums: list[str], extra: list[Column] = ()
) -> DataFrame:
    """Sums per range: one row per group and non-empty range."""
    return ranged.groupBy(*keys, *RANGE).agg(*[F.sum(c).alias(c) for c in sums], *extra)


def join_offsets(ranged: DataFrame, offsets: DataFrame, keys: list[str]) -> DataFrame:
    """Bring range offsets to the rows.

    Both sides are hashed by group and range, which is the distribution the
    window after it needs, so the rows move once.
    """
    return ranged.join(offsets.hint("shuffle_hash"), [*keys, *RANGE])


def before_range(keys: list[str]):
    """Window over the ranges before the current one."""
    return Window.partitionBy(*keys).orderBy(*RANGE).rowsBetween(
        Window.unboundedPreceding, -1
    )


def running_totals(
    df: DataFrame, keys: list[str], value: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Add ``cum_<c>`` for each of ``sums``: the total over rows up to the value.

    Rows with an equal value all count, as in a RANGE frame.
    """
    ranged = with_ranges(df, keys, value, descending)
    offsets = range_totals(ranged, keys, sums).select(
        *keys, *RANGE,
        *[
            F.coalesce(F.sum(c).over(before_range(keys)), F.lit(0)).alias(f"_off_{c}")
            for c in sums
        ],
    )
    order = F.col(value).desc() if descending else F.col(value)
    local = Window.partitionBy(*keys, *RANGE).orderBy(order).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    out = join_offsets(ranged, offsets, keys).withColumns(
        {f"cum_{c}": F.col(f"_off_{c}") + F.sum(c).over(local) for c in sums}
    )
    return out.drop(*RANGE, *[f"_off_{c}" for c in sums])


def ordinal_within(
    df: DataFrame, keys: list[str], value: str, ties: list[str], name: str
) -> DataFrame:
    """Zero-based position of each row in its group, by the value, then ``ties``.

    The ranges are cut by ``ties`` too, so a value that many rows share is split.
    """
    ranged = with_ranges(df, keys, value, ties=ties).withColumn("_one", F.lit(1).cast("long"))
    offsets = range_totals(ranged, keys, ["_one"]).select(
        *keys, *RANGE, F.coalesce(F.sum("_one").over(before_range(keys)), F.lit(0)).alias("_off")
    )
    local = Window.partitionBy(*keys, *RANGE).orderBy(value, *ties)
    return (
        join_offsets(ranged, offsets, keys)
        .withColumn(name, F.col("_off") + F.row_number().over(local) - 1)
        .drop(*RANGE, "_off", "_one")
    )
