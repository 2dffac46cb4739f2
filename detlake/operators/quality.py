"""Manifest checks. Every check runs; one report lists all problems.

Row checks are one narrow pass: each row yields the checks it fails, good rows
yield nothing. Only the failures are shuffled. The repeated-key check is the one
check with its own shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake import fixed_values as fv, schema
from detlake.functions.numeric import is_finite
from detlake.session import materialize

EXAMPLES = 3


class ManifestInvalid(ValueError):
    """A manifest with the list of everything wrong with it."""


# --- predicates: true on a bad row ------------------------------------------

def outside(col: Column, allowed: list) -> Column:
    return col.isNotNull() & ~col.isin(allowed)


def is_sentinel(col: Column) -> Column:
    """A placeholder in place of NULL; case is ignored, surrounding space is not."""
    return F.lower(col).isin(fv.ATTACK_SENTINELS)


def unsafe_utt_id(col: Column) -> Column:
    return col.isNotNull() & (~col.rlike(fv.SAFE_UTT_ID) | col.isin(fv.RESERVED_UTT_IDS))


def unsafe_path(col: Column) -> Column:
    return col.isNotNull() & (
        F.startswith(col, F.lit("/"))
        | F.contains(col, F.lit("\\"))
        | F.array_contains(F.split(col, "/"), "..")
    )


# --- single checks -----------------------------------------------------------

def missing_columns(df: DataFrame) -> DataFrame:
    """Required columns the table lacks; metadata only, no scan."""
    lacking = [(c,) for c in schema.REQUIRED_COLUMNS if c not in df.columns]
    return df.sparkSession.createDataFrame(lacking, "column string")


def null_required(df: DataFrame) -> DataFrame:
    """NULL count per required column, all columns in one pass."""
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(c) for c in schema.REQUIRED_COLUMNS]
    )
    return counts.unpivot([], schema.REQUIRED_COLUMNS, "column", "n_bad")


def domain_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    """Each value outside the domain with its row count."""
    col = F.col(column)
    return (
        df.filter(outside(col, allowed))
        .groupBy(col.cast("string").alias("value"))
        .agg(F.count("*").alias("n_rows"))
    )


def duplicate_keys(df: DataFrame, key: list[str] = schema.KEY) -> DataFrame:
    """Keys held by more than one row, with all their rows counted.

    Counts combine before the shuffle, so a key repeated without end is one
    record per task.
    """
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def sentinel_values(df: DataFrame) -> DataFrame:
    """Placeholders found in ``attack_type`` and ``vocoder``, lower-cased."""
    cols = [c for c in ("attack_type", "vocoder") if c in df.columns]
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lower(F.col(c)).alias("value")) for c in cols
    ])
    return (
        df.select(F.inline(pairs))
        .filter(F.col("value").isin(fv.ATTACK_SENTINELS))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n_rows"))
    )


def foreign_dataset(df: DataFrame, dataset_id: str) -> DataFrame:
    """Rows of another dataset, counted per foreign id."""
    return (
        df.filter(~F.col("dataset_id").eqNullSafe(dataset_id))
        .groupBy("dataset_id")
        .agg(F.count("*").alias("n_rows"))
    )


# --- the whole report --------------------------------------------------------

def _problem(check: str, item: Column, example: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        item.cast("string").alias("item"),
        example.cast("string").alias("example"),
    )


def violations(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """One row per row check failed: ``check``, ``item``, ``example``.

    ``item`` is the column or the offending value the failures are counted by.
    """
    none = F.lit(None)
    key = F.concat_ws("/", *schema.KEY)
    checks = [
        F.when(F.col(c).isNull(), _problem("null_required", F.lit(c), key))
        for c in schema.REQUIRED_COLUMNS
    ]
    checks += [
        F.when(
            outside(F.col("label"), [fv.LABEL_BONAFIDE, fv.LABEL_SPOOF]),
            _problem("label_domain", F.col("label"), key),
        ),
        F.when(
            outside(F.col("split"), fv.SPLITS), _problem("split_domain", F.col("split"), key)
        ),
        F.when(unsafe_utt_id(F.col("utt_id")), _problem("unsafe_utt_id", none, F.col("utt_id"))),
        F.when(unsafe_path(F.col("path")), _problem("unsafe_path", none, F.col("path"))),
    ]
    for c in ("attack_type", "vocoder"):
        if c in df.columns:
            found = F.concat(F.lit(f"{c}="), F.lower(F.col(c)))
            checks.append(F.when(is_sentinel(F.col(c)), _problem("sentinel", found, key)))
    if dataset_id is not None:
        checks.append(
            F.when(
                ~F.col("dataset_id").eqNullSafe(dataset_id),
                _problem("foreign_dataset", F.col("dataset_id"), key),
            )
        )
    failed = F.filter(F.array(*checks), lambda p: p.isNotNull())
    return df.select(F.inline(failed))


def _summary(problems: DataFrame) -> DataFrame:
    """Count per check and item, with the first examples by text."""
    counts = problems.groupBy("check", "item").agg(F.sum("n").alias("n_bad"))
    order = Window.partitionBy("check", "item").orderBy("example")
    examples = (
        problems.select("check", "item", "example")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= EXAMPLES)
        .groupBy("check", "item")
        .agg(F.sort_array(F.collect_list("example")).alias("examples"))
    )
    same = counts["check"].eqNullSafe(examples["check"]) & counts["item"].eqNullSafe(
        examples["item"]
    )
    return counts.join(examples, same).select(
        counts["check"], counts["item"], "n_bad", "examples"
    )


def validation_report(df: DataFrame, dataset_id: str | None = None) -> DataFrame:
    """Everything wrong with a manifest: ``check, item, n_bad, examples``.

    Missing columns come alone, because nothing else can be checked then. The
    problems are stored first, so that the manifest is read once per kind of
    check and not again for the examples.
    """
    if any(c not in df.columns for c in schema.REQUIRED_COLUMNS):
        return missing_columns(df).select(
            F.lit("missing_column").alias("check"),
            F.col("column").alias("item"),
            F.lit(None).cast("long").alias("n_bad"),
            F.array().cast("array<string>").alias("examples"),
        )
    rows = violations(df, dataset_id).withColumn("n", F.lit(1).cast("long"))
    repeated = duplicate_keys(df).select(
        F.lit("duplicate_key").alias("check"),
        F.lit(None).cast("string").alias("item"),
        F.concat_ws("/", *schema.KEY).alias("example"),
        F.col("n_rows").alias("n"),
    )
    return _summary(materialize(rows.unionByName(repeated), "problems"))


def assert_valid(df: DataFrame, dataset_id: str | None = None) -> None:
    """Stop with the complete report when a manifest breaks the contract.

    The driver reads at most ``EXAMPLES`` lines per check, each with the rows and the
    number of distinct items (columns or offending values) behind the check.
    """
    report = materialize(validation_report(df, dataset_id), "report")
    totals = report.groupBy("check").agg(F.count("*").alias("items"), F.sum("n_bad").alias("rows"))
    first = Window.partitionBy("check").orderBy("item")
    shown = report.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= EXAMPLES)
    lines = [
        f"{r['check']} {r['item'] or ''}: {r['n_bad']} e.g. {r['examples']} "
        f"(of {r['items']} items, {r['rows']} rows)"
        for r in shown.join(totals, "check").orderBy("check", "item").collect()
    ]
    if lines:
        raise ManifestInvalid("manifest is not valid:\n" + "\n".join(lines))


# --- features and models -----------------------------------------------------

def feature_contract(frames: DataFrame, channels: int) -> DataFrame:
    """Add ``error`` to frame rows: NULL when the row has C finite values."""
    wrong_width = F.coalesce(F.size("coeffs") != channels, F.lit(True))
    finite = F.forall("coeffs", is_finite)
    return frames.withColumn(
        "error",
        F.when(
            wrong_width,
            F.concat(
                F.lit("width "), F.coalesce(F.size("coeffs").cast("string"), F.lit("NULL")),
                F.lit(f", expected {channels}"),
            ),
        ).when(~finite, "NaN or Inf in features"),
    )


def contract_failures(frames: DataFrame, channels: int) -> DataFrame:
    """Utterances with a bad frame: count and first error by text."""
    return (
        feature_contract(frames, channels)
        .filter(F.col("error").isNotNull())
        .groupBy(*schema.KEY)
        .agg(F.count("*").alias("n_bad"), F.min("error").alias("error"))
    )


class FeatureMismatch(ValueError):
    """Features, or a model trained on others, that do not fit what is asked for."""


def assert_contract(frames: DataFrame, channels: int) -> None:
    """Stop at the first utterances whose frames break the contract."""
    bad = contract_failures(frames, channels).limit(EXAMPLES).collect()
    if bad:
        raise FeatureMismatch(f"bad frames: e.g. {[r.asDict() for r in bad]}")


def assert_preflight(checked: DataFrame) -> None:
    """Stop where :func:`spec_preflight` found a problem; one row per parameter set is looked at."""
    bad = checked.filter(F.col("problem").isNotNull()).orderBy("name").limit(20).collect()
    if bad:
        raise FeatureMismatch("; ".join(f"{r['name']} ({r['feature_id']}): {r['problem']}" for r in bad))


def spec_preflight(wanted: DataFrame, specs: DataFrame, models: DataFrame) -> DataFrame:
    """Compare wanted features, built feature sets and trained models.

    ``wanted``: ``name, feature_id, channels``; ``specs``: ``feature_id,
    channels`` of what is built; ``models``: ``name, feature_id, in_channels``
    as trained, where NULL means the model did not record it. One row per wanted
    set with a ``problem`` or NULL. All three hold one row per parameter set.
    """
    built = specs.select("feature_id", F.col("channels").alias("built_channels"))
    trained = models.select(
        "name", F.col("feature_id").alias("trained_id"), "in_channels"
    )
    return (
        wanted.join(built, "feature_id", "left")
        .join(trained, "name", "left")
        .withColumn(
            "problem",
            F.when(F.col("built_channels").isNull(), "features not built")
            .when(F.col("built_channels") != F.col("channels"), "built width differs")
            .when(
                F.col("trained_id").isNotNull() & (F.col("trained_id") != F.col("feature_id")),
                "model trained on other features",
            )
            .when(
                F.col("in_channels").isNotNull() & (F.col("in_channels") != F.col("channels")),
                "model expects another width",
            ),
        )
        .select("name", "feature_id", "channels", "problem")
    )
