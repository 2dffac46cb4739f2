"""Build one dataset's manifest: adapter, checks, storage, passport tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from detlake import schema
from detlake.operators import profile, quality
from detlake.session import materialize
from detlake.sinks.tables import replace_table
from detlake.sources.adapters import ADAPTERS

PASSPORT = ("fingerprint", "class_balance", "columns", "values")


def build_manifest(
    spark: SparkSession, adapter: str, dataset_id: str, out: str | None = None, table: str | None = None, **inputs
) -> DataFrame:
    """Run a registered adapter, stop on any problem, store and return the manifest.

    ``out`` is a new path; what is stored there is what ``scan_manifest`` reads. With the name of a
    catalog ``table``, ``out`` holds its versions and the table is replaced. The passport is
    stored with the manifest (:func:`read_passport`).
    """
    built = ADAPTERS.get(adapter)(spark, dataset_id, **inputs)
    manifest = materialize(built, "manifest")
    quality.assert_valid(manifest, dataset_id)
    if out:
        stored = manifest.select(*schema.MANIFEST.names)
        if table:
            out = replace_table(stored, table, out)
        else:
            stored.write.parquet(out)
        for name, part in passport(stored).items():
            part.coalesce(1).write.parquet(f"{out}/_passport/{name}")
    return manifest


def build_all(
    spark: SparkSession, jobs: list[dict]
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Build several datasets; a broken one is reported and the rest go on."""
    built, failed = {}, {}
    for job in jobs:
        try:
            built[job["dataset_id"]] = build_manifest(spark, **job)
        except Exception as e:
            failed[job["dataset_id"]] = f"{type(e).__name__}: {e}"
    return built, failed


def passport(manifest: DataFrame) -> dict[str, DataFrame]:
    """What describes a manifest: identity, balance, coverage and values."""
    return {
        "fingerprint": profile.table_fingerprint(manifest),
        "class_balance": profile.class_balance(manifest),
        "columns": profile.column_profile(manifest),
        "values": profile.value_counts_capped(manifest),
    }


def read_passport(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of :func:`passport` as they were stored with a manifest; readers of the manifest pass over them."""
    return {name: spark.read.parquet(f"{path}/_passport/{name}") for name in PASSPORT}
