"""Evaluate a scorer on selected data, resumable, with metrics per dataset."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from detlake import fixed_values as fv, schema
from detlake.operators import bootstrap, detection, profile, resume
from detlake.operators.manifest import select_split
from detlake.operators.quality import assert_preflight, spec_preflight
from detlake.plans.extract import read_table, specs
from detlake.session import materialize
from detlake.sinks import tables
from detlake.sources.files import content_digest


class CoverageTooLow(RuntimeError):
    """Too few of the requested rows could be scored."""


@dataclass(frozen=True)
class RunConditions:
    """What a score depends on; any change starts a new run.

    ``weights_path`` is the file or folder the weights are read from: its content counts, so
    other bytes under the same name are another run.
    """

    weights: str
    epoch: int | None = None
    model_name: str | None = None
    feature_id: str | None = None
    t_fixed: int | None = fv.DEFAULT_T_FIXED
    window: str = "fixed"
    selectors: list[tuple[str, str]] = field(default_factory=list)
    weights_path: str | None = None
    channels: int | None = None


def run_fingerprint(
    weights: Column, epoch: Column, model_name: Column, feature_id: Column,
    t_fixed: Column, window: Column, selectors: Column,
) -> Column:
    """sha1 over the conditions as JSON; ``selectors`` is an array of strings."""
    doc = F.struct(
        weights.alias("weights"), epoch.alias("epoch"), model_name.alias("model_name"),
        feature_id.alias("feature_id"), t_fixed.alias("t_fixed"), window.alias("window"),
        F.sort_array(selectors).alias("selectors"),
    )
    return F.sha1(F.to_json(doc, {"ignoreNullFields": "false"}))


def run_id(df: DataFrame, c: RunConditions) -> str:
    """The fingerprint of one run as a string."""
    chosen = F.array(*[F.lit(f"{d}:{s}") for d, s in c.selectors]) if c.selectors else F.array()
    weights = c.weights
    if c.weights_path is not None:
        weights = f"{c.weights}:{content_digest(df.sparkSession, c.weights_path)}"
    one = df.sparkSession.range(1).select(
        run_fingerprint(
            F.lit(weights), F.lit(c.epoch), F.lit(c.model_name), F.lit(c.feature_id),
            F.lit(c.t_fixed), F.lit(c.window), chosen.cast("array<string>"),
        ).alias("id")
    )
    return one.first()["id"]


def preflight_of(
    spark: SparkSession, c: RunConditions, features: str, models: DataFrame | None = None
) -> DataFrame:
    """``quality.spec_preflight`` of the one feature set that a run wants; ``models``: ``name, feature_id, in_channels``."""
    if c.feature_id is None:
        raise ValueError("a run on a feature table needs a feature_id")
    built = specs(read_table(spark, features))
    channels = F.lit(c.channels).cast("int") if c.channels is not None else F.col("channels")
    wanted = spark.range(1).select(F.lit(c.model_name or c.weights).alias("name"), F.lit(c.feature_id).alias("feature_id"))
    wanted = wanted.join(built.select("feature_id", "channels"), "feature_id", "left").withColumn("channels", channels)
    if models is None:
        models = spark.createDataFrame([], "name string, feature_id string, in_channels int")
    return spec_preflight(wanted, built, models)


def score_resumable(
    requested: DataFrame, score: Callable[[DataFrame], DataFrame], root: str, run: str,
    shard_rows: int = fv.DEFAULT_SHARD_ROWS,
) -> DataFrame:
    """Score the keys this run lacks, store them and return all scores of the run."""
    spark = requested.sparkSession
    todo = requested
    if tables.path_exists(spark, root):
        done = tables.read_score_shards(spark, root, run)
        todo = resume.todo_by_key(requested, done)
    tables.write_score_shards(score(todo), root, run, shard_rows)
    return tables.merge_score_shards(tables.read_score_shards(spark, root, run))


def dataset_metrics(
    scores: DataFrame, n_boot: int = fv.DEFAULT_BOOTSTRAP, seed: int = fv.DEFAULT_SEED,
    ci: float = fv.DEFAULT_CI, val_threshold: float | None = None,
) -> dict[str, DataFrame]:
    """Metric tables of a score table; every row belongs to one dataset."""
    val = None
    if val_threshold is not None:
        val = scores.select("dataset_id").distinct().withColumn(
            "threshold", F.lit(float(val_threshold))
        )
    interval = materialize(bootstrap.eer_bootstrap(scores, n_boot, seed, ci), "interval")
    point = materialize(detection.eer(scores, ["dataset_id"]), "point")
    summary = (
        profile.dataset_counts(scores)
        .join(point, "dataset_id", "left")
        .join(interval, "dataset_id", "left")
        .select(
            "dataset_id", "n", "n_bonafide", "n_spoof", "n_spoof_without_attack_type",
            F.bround("eer", 6).alias("eer"), F.col("threshold").alias("eer_threshold"),
            F.bround("lo", 6).alias("ci_lo"), F.bround("hi", 6).alias("ci_hi"),
            F.lit(ci).alias("ci_level"),
            F.coalesce("n_boot", F.lit(0).cast("long")).alias("bootstrap_n"),
        )
    )
    return {
        "summary": summary,
        "operating_points": detection.operating_points(scores, val, point=point),
        "by_attack": detection.eer_by_group(scores, ["dataset_id"]),
        "report": detection.eer_report(
            scores, interval if n_boot > 0 else None, point
        ),
    }


def evaluate_experiment(
    manifest: DataFrame,
    selectors: list[tuple[str, str]],
    score: Callable[[DataFrame], DataFrame],
    conditions: RunConditions,
    shards: str,
    *,
    min_coverage: float = fv.DEFAULT_MIN_COVERAGE,
    allow_missing: bool = False,
    history: DataFrame | None = None,
    n_boot: int = fv.DEFAULT_BOOTSTRAP,
    seed: int = fv.DEFAULT_SEED,
    ci: float = fv.DEFAULT_CI,
    shard_rows: int = fv.DEFAULT_SHARD_ROWS,
    preflight: DataFrame | None = None,
    features: str | None = None,
    models: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Selected rows to scores, coverage and metric tables.

    ``score`` maps manifest rows to ``dataset_id, utt_id, score`` for the rows it
    has features for. Scores are stored before the coverage decides, so nothing
    is computed twice after a stop. With a feature table (``features``) the
    feature set of the conditions is checked against what is built there and, where given, against the
    trained ``models`` before anything is scored; ``preflight`` is a result of
    ``quality.spec_preflight`` instead. Any problem stops the run. Other
    windows than ``fixed`` do not exist.
    """
    if preflight is None and features is not None:
        preflight = preflight_of(manifest.sparkSession, conditions, features, models)
    if preflight is not None:
        assert_preflight(preflight)
    if conditions.window != "fixed":
        raise NotImplementedError(f"window {conditions.window!r}: only 'fixed' is supported")
    requested = select_split(manifest, selectors).select(
        *schema.KEY, "label", "split", "attack_type"
    )
    run = run_id(manifest, conditions)
    merged = score_resumable(requested, score, shards, run, shard_rows)
    scored = materialize(resume.attach_scores(requested, merged), "scores")
    coverage = resume.coverage_gate(resume.coverage_stats(requested, scored), min_coverage)
    state = coverage.first()
    if not state["passed"] and not allow_missing:
        raise CoverageTooLow(
            f"{state['n_scored']} of {state['n_requested']} rows scored, "
            f"coverage {state['ratio']} is below {min_coverage}"
        )
    threshold = None
    if history is not None and conditions.epoch is not None:
        found = history.filter(F.col("epoch") == conditions.epoch)
        row = resume.first_wins(found, ["epoch"], ["seq"]).first()
        threshold = row["val_threshold"] if row else None
    return {
        "scores": scored.orderBy(*schema.KEY),
        "coverage": coverage,
        **dataset_metrics(scored, n_boot, seed, ci, threshold),
    }
