"""Folds by id, bounded samples of labelled rows to fit a model on, and column names that are free."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_CLASSES = 1024


def fold(n: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def bounded(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """About ``bound`` rows of each class by a hash of ``doc_id``, and ``weight`` = rows per kept row.

    Classes with fewer rows keep all. The classes are a closed set: more than
    ``MAX_CLASSES`` raise ``ValueError``, so the counts on the driver stay small.
    """
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("_n"))
    found = counts.limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values")
    small = F.broadcast(rows.sparkSession.createDataFrame(found, counts.schema))
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    kept = rows.join(small, label).filter(share < F.lit(float(bound)) / F.col("_n"))
    return kept.withColumn("weight", F.greatest(F.col("_n") / float(bound), F.lit(1.0))).drop("_n")


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``docs``."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
