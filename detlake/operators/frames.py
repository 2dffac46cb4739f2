"""Frame tables: fixed length, crops, slopes, pooling, framing.

Long form has one row per ``(dataset_id, utt_id, frame)``. An utterance can be
arbitrarily long, so slopes work on bounded pieces of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake import fixed_values as fv, schema
from detlake.functions.numeric import md5_int
from detlake.functions.signal import slope_weights

PIECE = 4096  # frames per piece of an utterance


# --- length ------------------------------------------------------------------

def fix_length(
    frames: DataFrame, t_fixed: int, keys: list[str] = schema.KEY
) -> DataFrame:
    """Exactly ``t_fixed`` frames per utterance: cut from the start or repeat.

    The cut is a filter that reaches the scan; after it an utterance has at most
    ``t_fixed`` rows, so counting them in a window is bounded work.
    """
    head = frames.filter(F.col("frame") < t_fixed)
    t = F.count("*").over(Window.partitionBy(*keys))
    copies = F.sequence(F.lit(0), F.ceil(F.lit(t_fixed) / F.col("_t")).cast("int") - 1)
    return (
        head.withColumn("_t", t)
        .withColumn("_copy", F.explode(copies))
        .withColumn("frame", (F.col("frame") + F.col("_copy") * F.col("_t")).cast("int"))
        .filter(F.col("frame") < t_fixed)
        .drop("_t", "_copy")
    )


def assert_frames(keys_of: DataFrame, frames: DataFrame, keys: list[str] = schema.KEY) -> None:
    """Stop where an utterance of ``keys_of`` has no frame at all, which the long form cannot show."""
    gone = keys_of.select(*keys).join(frames.filter("frame = 0").select(*keys), keys, "left_anti").limit(3).collect()
    if gone:
        raise ValueError(f"utterances without frames: e.g. {[tuple(r) for r in gone]}")


def fix_length_array(matrix: Column, t_fixed: int) -> Column:
    """The same for one array per utterance; an empty one stops the job."""
    t = F.size(matrix)
    whole = F.flatten(
        F.array_repeat(matrix, F.ceil(F.lit(t_fixed) / t).cast("int"))
    )
    return F.when(t == 0, F.raise_error(F.lit("utterance without frames"))).otherwise(
        F.when(t >= t_fixed, F.slice(matrix, 1, t_fixed)).otherwise(
            F.slice(whole, 1, t_fixed)
        )
    )


def crop_start(t: Column, t_fixed: int, seed: int, epoch: int, keys: list[str]) -> Column:
    """Start in ``0..T-t_fixed``, fixed by seed, epoch and key; 0 when too short."""
    room = F.greatest(t - t_fixed, F.lit(0)) + 1
    return F.pmod(md5_int(F.lit(seed), F.lit(epoch), *keys), room).cast("int")


def random_crop(
    frames: DataFrame, t_fixed: int, epoch: int, seed: int = fv.DEFAULT_SEED,
    keys: list[str] = schema.KEY, n_frames: str | None = None,
) -> DataFrame:
    """A seeded window of long utterances; short ones repeat from the start.

    When the table stores the length of each utterance (``n_frames``), as the
    feature table does, the start follows from the row itself and no join is
    needed.
    """
    if n_frames:
        start = crop_start(F.col(n_frames), t_fixed, seed, epoch, keys)
        moved = frames.withColumn("frame", F.col("frame") - start).filter(
            (F.col("frame") >= 0) & (F.col("frame") < t_fixed)
        )
        return fix_length(moved, t_fixed, keys)
    counts = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("_t"))
    starts = counts.select(
        *keys, crop_start(F.col("_t"), t_fixed, seed, epoch, keys).alias("_start")
    )
    moved = (
        frames.join(starts, keys)
        .withColumn("frame", F.col("frame") - F.col("_start"))
        .filter((F.col("frame") >= 0) & (F.col("frame") < t_fixed))
        .drop("_start")
    )
    return fix_length(moved, t_fixed, keys)


# --- slopes ------------------------------------------------------------------

def half_width(t: Column, width: int) -> Column:
    """Half of the largest odd window that fits ``t`` frames."""
    return F.floor((F.least(F.lit(width), t) - 1) / 2).cast("int")


def with_delta(
    frames: DataFrame, value: str = "value", order: int = 1, width: int = 9,
    keys: list[str] = schema.KEY, name: str | None = None, n_frames: str | None = None,
) -> DataFrame:
    """Add the regression slope (or curvature) over the frames around each frame.

    Frames nearer than half a window to an end copy the nearest full window.
    Utterances under three frames have none and get NULL. Each utterance is cut
    into pieces that carry the neighbouring frames they need, so one endless
    recording still spreads over the cluster. A stored length (``n_frames``, as in
    the feature table) saves counting frames and the join that brings the count.
    """
    name = name or ("delta" if order == 1 else "delta2")
    widest = width // 2
    halo = 2 * widest
    f = F.col("frame")

    own = F.floor(f / PIECE).cast("int")
    near = F.array_distinct(F.array(
        own, F.greatest(F.floor((f - halo) / PIECE).cast("int"), F.lit(0)),
        F.floor((f + halo) / PIECE).cast("int"),
    ))
    spread = frames.withColumn("_own", own).withColumn("_piece", F.explode(near))
    at = [*keys, "_piece"]
    if n_frames:
        joined = spread.withColumn("_t", F.col(n_frames))
    else:
        counts = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("_t"))
        last = F.floor((F.col("_t") - 1) / PIECE).cast("int")
        pieces = counts.withColumn("_piece", F.explode(F.sequence(F.lit(0), last)))
        joined = spread.join(pieces, at)
    joined = joined.withColumn("_h", half_width(F.col("_t"), width))

    window = Window.partitionBy(*at)
    along = window.orderBy("frame")
    x = F.col(value).cast("double")
    slope = F.lit(None).cast("double")
    for h in range(1, widest + 1):
        w = [float(v) for v in slope_weights(h, order)]
        total = x * w[h]
        for i in range(1, h + 1):
            total = total + F.lead(x, i).over(along) * w[h + i] + F.lag(x, i).over(along) * w[h - i]
        slope = F.when(F.col("_h") == h, total).otherwise(slope)
    full = (f >= F.col("_h")) & (f <= F.col("_t") - 1 - F.col("_h"))
    inner = joined.withColumn("_d", F.when(full, slope))
    left = F.max(F.when(f == F.col("_h"), F.col("_d"))).over(window)
    right = F.max(F.when(f == F.col("_t") - 1 - F.col("_h"), F.col("_d"))).over(window)
    return (
        inner.withColumn(
            name,
            F.when(f < F.col("_h"), left)
            .when(f > F.col("_t") - 1 - F.col("_h"), right)
            .otherwise(F.col("_d")),
        )
        .filter(F.col("_piece") == F.col("_own"))
        .select(*frames.columns, name)
    )


# --- pooling -----------------------------------------------------------------

def _std(col: Column) -> Column:
    return F.sqrt(F.greatest(F.var_pop(col), F.lit(fv.STD_FLOOR)))


def masked_stat_pool(
    frames: DataFrame, channels: int, keys: list[str] = schema.KEY,
    valid: Column | None = None,
) -> DataFrame:
    """``mean`` and ``std`` arrays per utterance over its valid frames.

    The number of channels is known, so the statistics are plain aggregates that
    combine in each task; frames are never expanded per channel. The variance is
    of the population, with a floor.
    """
    rows = frames if valid is None else frames.filter(valid)
    at = [F.get("coeffs", F.lit(i)).cast("double") for i in range(channels)]
    return rows.groupBy(*keys).agg(
        F.array(*[F.avg(c) for c in at]).alias("mean"),
        F.array(*[_std(c) for c in at]).alias("std"),
    )


def pooled_features(
    frames: DataFrame, channels: int, t_fixed: int, keys: list[str] = schema.KEY
) -> DataFrame:
    """One vector ``[means, stds]`` per utterance of fixed length."""
    pooled = masked_stat_pool(fix_length(frames, t_fixed, keys), channels, keys)
    return pooled.select(*keys, F.concat("mean", "std").alias("features"))


# --- framing -----------------------------------------------------------------

def frame_signal(
    waves: DataFrame, n_fft: int, hop: int, keys: list[str] = schema.KEY
) -> DataFrame:
    """Centred frames of each signal: zeros on both sides, ``1 + N // hop`` rows."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), n_fft // 2)
    padded = F.concat(zeros, F.col("samples"), zeros)
    last = F.floor((F.size("_x") - 2 * (n_fft // 2)) / hop).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last),
        lambda f: F.slice(F.col("_x"), f * hop + 1, F.lit(n_fft)),
    )
    # The frames replace the signal before they become rows, so a row never
    # carries the whole signal along.
    return (
        waves.select(*keys, padded.alias("_x"))
        .select(*keys, cut.alias("_frames"))
        .select(*keys, F.posexplode("_frames").alias("frame", "samples"))
    )
