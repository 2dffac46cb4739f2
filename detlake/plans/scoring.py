"""Fit scorers and score utterances in bulk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from detlake import fixed_values as fv, schema
from detlake.operators.detection import eer
from detlake.operators.frames import pooled_features
from detlake.operators.profile import pos_weight
from detlake.registry import Registry
from detlake.session import broadcast_if_small, materialize, ship_package

SCORERS = Registry("scorer")


def class_weight(train: DataFrame, mode: str | float | None = "auto") -> float:
    """Weight of a spoof row: ``auto`` from the rows given, ``none``, or a number."""
    if mode in (None, "none", False):
        return 1.0
    if mode == "auto":
        return pos_weight(train).first()["pos_weight"] or 1.0
    return float(mode)


def fit_scorer(
    train: DataFrame, weight: str | float | None = "auto", reg: float = 0.0,
    max_iter: int = 50,
) -> LogisticRegressionModel:
    """Class-weighted logistic model on ``features`` arrays.

    Every optimiser step is one distributed pass that moves a gradient.
    """
    w = class_weight(train, weight)
    data = train.select(
        F.col("label").cast("double").alias("label"),
        array_to_vector("features").alias("features"),
        F.when(F.col("label") == fv.LABEL_SPOOF, w).otherwise(1.0).alias("weight"),
    )
    return LogisticRegression(
        weightCol="weight", regParam=reg, maxIter=max_iter, standardization=True
    ).fit(data)


def batch_score(model: LogisticRegressionModel, pooled: DataFrame) -> DataFrame:
    """Raw logit of the spoof class as ``score``; the key travels with its row."""
    keep = [c for c in pooled.columns if c != "features"]
    out = model.transform(pooled.withColumn("features", array_to_vector("features")))
    return out.select(*keep, F.get(vector_to_array("rawPrediction"), F.lit(1)).alias("score"))


def least_eer(scored: DataFrame) -> tuple[int, DataFrame]:
    """Candidate with the least EER of a table with a ``candidate`` column, and the table of all.

    One grouped pass for all candidates; the first one wins a tie, NULL never wins.
    """
    table = materialize(eer(scored, ["candidate"]).select("candidate", F.col("eer").alias("val_eer")), "candidates")
    best = table.filter(F.col("val_eer").isNotNull()).orderBy("val_eer", "candidate").first()
    if best is None:
        raise ValueError("no candidate has a dev EER: one class only")
    return best["candidate"], table


def select_by_val_eer(
    train: DataFrame, dev: DataFrame, grid: list[dict]
) -> tuple[int, LogisticRegressionModel, DataFrame]:
    """Fit every candidate on the cluster, score all of them on dev and pick by :func:`least_eer`.

    Returns its index, its model and the table of candidates.
    """
    train, dev = train.persist(), dev.persist()
    try:
        models = [fit_scorer(train, **params) for params in grid]
        scored = [
            batch_score(m, dev).select("label", "score").withColumn("candidate", F.lit(i)) for i, m in enumerate(models)
        ]
        best, table = least_eer(reduce(DataFrame.unionByName, scored))
    finally:
        train.unpersist()
        dev.unpersist()
    return best, models[best], table


# --- statistics-pooling network, forward pass of given weights ----------------

@dataclass(frozen=True)
class StatPoolWeights:
    """Frame layer, hidden layer and output layer; sizes come from the model."""

    frame_w: np.ndarray   # [H, C]
    frame_b: np.ndarray   # [H]
    hidden_w: np.ndarray  # [H, 2H]
    hidden_b: np.ndarray  # [H]
    out_w: np.ndarray     # [H]
    out_b: float


def _logits(mean: np.ndarray, var: np.ndarray, w: StatPoolWeights) -> np.ndarray:
    std = np.sqrt(np.maximum(var, fv.STD_FLOOR))
    hidden = np.maximum(np.concatenate([mean, std], axis=1) @ w.hidden_w.T + w.hidden_b, 0.0)
    return hidden @ w.out_w + w.out_b


def statpool_logits(x: np.ndarray, lengths: np.ndarray, w: StatPoolWeights) -> np.ndarray:
    """Logits of a batch ``[B, T, C]`` of which ``lengths`` frames are valid."""
    h = np.maximum(x @ w.frame_w.T + w.frame_b, 0.0)
    mask = (np.arange(x.shape[1]) < lengths[:, None])[..., None]
    n = np.maximum(mask.sum(axis=1), 1)
    mean = (h * mask).sum(axis=1) / n
    return _logits(mean, (((h - mean[:, None]) ** 2) * mask).sum(axis=1) / n, w)


def _lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    ends = np.arange(0, values.size + 1, max(values.shape[1], 1), dtype=np.int32)[:len(values) + 1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))


def _moments(w: StatPoolWeights, channels: int, t_fixed: int):
    """Per run of frames of one utterance: number, mean and squared deviations of every hidden unit.

    A frame of an utterance of ``_t`` frames counts as often as it stands in the
    repetition to ``t_fixed`` frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            coeffs = batch.column("coeffs")
            if not (np.diff(coeffs.offsets.to_numpy()) == channels).all():
                raise ValueError(f"a frame has not {channels} coefficients")
            x = coeffs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, channels)
            h = np.maximum(x @ w.frame_w.T + w.frame_b, 0.0)
            frame, t = (batch.column(c).to_numpy().astype(np.int64) for c in ("frame", "_t"))
            times = ((t_fixed - 1 - frame) // t + 1).astype(np.float64)
            new = np.zeros(len(batch), bool)
            new[0] = True
            for key in batch.columns[:len(schema.KEY)]:
                new[1:] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(new)
            n = np.add.reduceat(times, start)
            mean = np.add.reduceat(h * times[:, None], start, axis=0) / n[:, None]
            off = (h - mean[np.cumsum(new) - 1]) ** 2 * times[:, None]
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(start)) for c in batch.columns[:len(schema.KEY)]),
                 pa.array(n), _lists(mean), _lists(np.add.reduceat(off, start, axis=0))],
                [*schema.KEY, "n", "mean", "m2"])

    return run


def _score_moments(w: StatPoolWeights):
    """Logits of utterances from the moments of their parts, merged exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            parts = batch.column("parts")
            start, rows = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py(), parts.flatten()
            column = lambda c: rows.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            n, mean, m2 = rows.field("n").to_numpy(zero_copy_only=False)[:, None], column("mean"), column("m2")
            total = np.add.reduceat(n, start, axis=0)
            both = np.add.reduceat(mean * n, start, axis=0) / total
            own = np.repeat(np.arange(len(batch)), np.diff(np.append(start, len(rows))))
            var = np.add.reduceat(m2 + (mean - both[own]) ** 2 * n, start, axis=0) / total
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(schema.KEY)], pa.array(_logits(both, var, w))], [*schema.KEY, "score"])

    return run


def score_statpool_mlp(
    frames: DataFrame, channels: int, t_fixed: int, weights: StatPoolWeights, n_frames: str | None = None
) -> DataFrame:
    """``dataset_id, utt_id, score`` of every utterance with frames.

    Frames stay where they are read: each task turns them into the moments of the
    hidden units, one small row per utterance it holds a part of, and only those are
    shuffled and merged. The table's column of utterance lengths is used (``n_frames``, or
    the column of that name); without one the lengths are counted from the frame
    numbers first and joined. The weights travel in the function; their size is
    that of the model, not of the data.
    """
    ship_package(frames.sparkSession)
    length = n_frames or ("n_frames" if "n_frames" in frames.columns else None)
    head = frames.filter(F.col("frame") < t_fixed)
    if length is None:
        counts = head.groupBy(*schema.KEY).agg(F.count("*").alias("_t"))
        head = head.join(broadcast_if_small(counts), schema.KEY)
    else:
        head = head.withColumn("_t", F.least(F.col(length), F.lit(t_fixed)))
    kinds = ", ".join(f"{c} string" for c in schema.KEY)
    parts = head.select(*[F.col(c).cast("string").alias(c) for c in schema.KEY], "frame", "coeffs", "_t").mapInArrow(
        _moments(weights, channels, t_fixed), f"{kinds}, n double, mean array<double>, m2 array<double>")
    whole = parts.groupBy(*schema.KEY).agg(F.collect_list(F.struct("n", "mean", "m2")).alias("parts"))
    return whole.mapInArrow(_score_moments(weights), f"{kinds}, score double")


# --- scorers behind one interface: frames in, ``dataset_id, utt_id, score`` out ---

@dataclass(frozen=True)
class LogisticScorer:
    """A fitted logistic model on pooled frames of fixed length."""

    model: LogisticRegressionModel
    channels: int
    t_fixed: int

    def score(self, frames: DataFrame) -> DataFrame:
        pooled = pooled_features(frames, self.channels, self.t_fixed)
        return batch_score(self.model, pooled).select(*schema.KEY, "score")


@dataclass(frozen=True)
class StatPoolScorer:
    """The statistics-pooling network with given weights."""

    weights: StatPoolWeights
    channels: int
    t_fixed: int

    def score(self, frames: DataFrame) -> DataFrame:
        return score_statpool_mlp(frames, self.channels, self.t_fixed, self.weights)  # by stored lengths where there are any


SCORERS.add("logistic", LogisticScorer)
SCORERS.add("statpool_mlp", StatPoolScorer)
