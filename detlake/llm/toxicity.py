"""Toxicity: a factorization machine over hashed terms.

Terms are runs of letters and digits of the lower-cased text, and the beginnings
of ``PREFIXES`` bytes of longer ones, which catch inflected and compound forms;
a beginning that 2, 3 or 5 different words of a text share is a further term. Terms
are hashed to ``BINS`` bins, and a text has each of its terms once. A linear fit with an L1 penalty finds the
terms that matter, and the machine then learns their weights and ``FACTORS``
factors each, so that a pair of terms can say what neither says alone. The counts
per term and label that decide which ``SCREENED`` terms the fit looks at are a Spark
job.

The fit runs on the driver over a bounded sample: at most about ``PER_CLASS``
labelled texts of each class, weighted back to the class shares. Scoring is one
pass without a shuffle.

Defined cases: null and empty texts score as texts without terms; no labelled row
gives score 0 for all; one class only gives that class's rate; a document labelled
twice is toxic if one label says so; rows may repeat; null ids are scored; very long texts count
whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from detlake.llm.sample import bounded, fold
from detlake.llm.text import NOT_ALNUM, Words, hashes, mix, pieces, words
from detlake.session import materialize

BINS = 1 << 18
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 3, 5)
PER_CLASS = 6000
SCREENED = 4096
FACTORS = 8
L1, L2 = 1e-3, 1e-3
LINEAR_STEPS, STEPS, RATE = 200, 150, 0.05
ACTIVE = 512


def _terms(column: pa.Array):
    """Pieces of the column with the bins of their distinct terms: first row, end, rows, bins."""
    for a, b, data, offsets in pieces(column):
        found = words(data, offsets, NOT_ALNUM)
        full, rows = hashes(data, found), found.rows()
        _, once = np.unique(mix(full + rows.astype(np.uint64) * np.uint64(BINS + 1)), return_index=True)
        all_rows, all_bins = [rows[once]], [full[once] >> np.uint64(46)]
        for k in PREFIXES:
            longer = once[found.ends[once] - found.starts[once] > k]
            starts = np.sort(found.starts[longer])
            begin = mix(hashes(data, Words(starts, starts + k, found.row_at)) + np.uint64(k))
            own = np.searchsorted(offsets, starts, "right").astype(np.uint64) - np.uint64(1)
            pair, shared = np.unique(own << np.uint64(18) | begin >> np.uint64(46), return_counts=True)
            for level in LEVELS:
                some = pair[shared >= level]
                all_rows.append((some >> np.uint64(18)).astype(np.int64))
                all_bins.append(mix((some & np.uint64(BINS - 1)) * np.uint64(64) + np.uint64(8 * k + level)) >> np.uint64(46))
        yield a, b, np.concatenate(all_rows), np.concatenate(all_bins).astype(np.int64)


def _feature_batches(batches):
    for batch in batches:
        out = [np.zeros(0, np.int32)] * len(batch)
        for a, b, rows, bins in _terms(batch.column(2)):
            pair = np.unique(rows * BINS + bins)
            cut = np.searchsorted(pair, np.arange(b - a + 1) * BINS)
            for i in range(b - a):
                out[a + i] = (pair[cut[i]:cut[i + 1]] % BINS).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], ["label", "weight", "terms"])


@dataclass
class Model:
    """Bias, and by active term: slot of a bin (-1: none), weight, factors."""

    bias: float
    slot: np.ndarray
    w: np.ndarray
    v: np.ndarray


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _linear(y, weight, rows, cols, n_cols, l1):
    """L1-penalised logistic regression by accelerated proximal steps."""
    n, share = len(y), weight / weight.sum()
    w, ahead, b, b_ahead, t = np.zeros(n_cols), np.zeros(n_cols), 0.0, 0.0, 1.0
    rate = 4.0 / max(1.0, (np.bincount(rows, minlength=n) * share).sum() + 1)
    for _ in range(LINEAR_STEPS):
        z = np.bincount(rows, ahead[cols], minlength=n) + b_ahead
        miss = (_sigmoid(z) - y) * share
        new = ahead - rate * np.bincount(cols, miss[rows], minlength=n_cols)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        new_b, new_t = b_ahead - rate * miss.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, b_ahead = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


def _machine(y, weight, x, w, b):
    """Fit bias, weights and factors of the active terms by Adam; ``x`` is 0/1, text by term."""
    share = weight / weight.sum()
    rng = np.random.default_rng(7)
    params = [np.array([b]), w.copy(), rng.normal(0, 0.05, (len(w), FACTORS))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        bias, w, v = params
        xv = x @ v
        z = bias + x @ w + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1))
        miss = (_sigmoid(z) - y) * share
        grads = [
            np.array([miss.sum()]),
            x.T @ miss + L2 * w * 0.1,
            x.T @ (miss[:, None] * xv) - v * (x.T @ miss)[:, None] + L2 * v,
        ]
        for p, g, m, s in zip(params, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit_features(y: np.ndarray, weight: np.ndarray, terms: list[np.ndarray]) -> Model:
    """Fit on texts given as arrays of distinct term bins."""
    slot = np.full(BINS, -1, np.int32)
    none = np.zeros(0), np.zeros((0, FACTORS))
    if not len(y):
        return Model(-np.inf, slot, *none)
    rate = float((y * weight).sum() / weight.sum())
    if rate in (0.0, 1.0):
        return Model(np.inf if rate else -np.inf, slot, *none)
    rows = np.repeat(np.arange(len(y)), [len(t) for t in terms])
    bins, cols = np.unique(np.concatenate(terms), return_inverse=True)
    l1 = L1 if len(y) * L1 > 2 else 2 / len(y)
    w, b = _linear(y, weight, rows, cols, len(bins), l1)
    active = np.argsort(-np.abs(w), kind="stable")[:ACTIVE]
    active = active[w[active] != 0]
    if not len(active):
        return Model(float(np.log(rate / (1 - rate))), slot, *none)
    place = np.full(len(bins), -1)
    place[active] = np.arange(len(active))
    x = np.zeros((len(y), len(active)), np.float32)
    here = place[cols] >= 0
    x[rows[here], place[cols[here]]] = 1
    b, w, v = _machine(y, weight, x, w[active], b)
    slot[bins[active]] = np.arange(len(active))
    return Model(b, slot, w, v)


def _telling(rows: DataFrame) -> np.ndarray:
    """The ``SCREENED`` bins whose shares among the texts of both labels differ most, in standard errors."""
    size = dict.fromkeys((0, 1), 0) | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not all(size.values()):
        return np.zeros(0, np.int32)
    counts = rows.select("label", F.explode("terms").alias("bin")).groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("label").alias("n1")).toArrow()  # at most BINS rows
    bins, n, n1 = (counts[c].to_numpy() for c in ("bin", "n", "n1"))
    share = n / (size[0] + size[1])
    gap = n1 / size[1] - (n - n1) / size[0]
    z = np.abs(gap) / np.sqrt(share * (1 - share) * (1 / size[0] + 1 / size[1]) + 1e-9)
    return np.sort(bins[np.lexsort((bins, -z))[:SCREENED]])


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = PER_CLASS) -> Model:
    """Learn ``toxic`` of ``labels`` from the texts of the documents where ``train`` holds."""
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("label")).filter("label in (0, 1)")
    labels = labels if train is None else labels.filter(train)
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = F.broadcast(bounded(labels, "label", per_class))  # at most about 2 * per_class rows
    rows = docs.select("doc_id", F.lower("text").alias("text")).join(chosen, "doc_id").select("label", "weight", "text")
    rows = materialize(rows.mapInArrow(_feature_batches, "label int, weight double, terms array<int>"), "toxicity-terms")
    shared = docs.sparkSession.sparkContext.broadcast(_telling(rows))

    def screened(batches):
        for batch in batches:
            terms = batch.column(2)
            flat, row = terms.flatten().to_numpy(), np.repeat(np.arange(len(batch)), terms.value_lengths().to_numpy())
            here = np.isin(flat, shared.value)
            at = np.searchsorted(row[here], np.arange(len(batch) + 1)).astype(np.int32)
            kept = pa.ListArray.from_arrays(pa.array(at), pa.array(flat[here]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), kept], batch.schema.names)

    found = rows.mapInArrow(screened, rows.schema).toArrow()
    terms = found["terms"].combine_chunks()
    parts = np.split(terms.flatten().to_numpy(), np.cumsum(terms.value_lengths().to_numpy()))[:-1] if len(terms) else []
    return fit_features(found["label"].to_numpy().astype(float), found["weight"].to_numpy(), parts)


def score_rows(model: Model, rows: np.ndarray, bins: np.ndarray, n: int) -> np.ndarray:
    """Probabilities of ``n`` texts from the (row, bin) of their terms, repeats allowed."""
    at = model.slot[bins]
    size = max(1, len(model.w))
    pair = np.unique(rows[at >= 0] * size + at[at >= 0])
    row, col = pair // size, pair % size
    z = np.full(n, model.bias)
    if len(pair):
        z += np.bincount(row, model.w[col], minlength=n)
        for f in model.v.T:
            z += 0.5 * (np.bincount(row, f[col], minlength=n) ** 2 - np.bincount(row, f[col] ** 2, minlength=n))
    return _sigmoid(z) if np.isfinite(model.bias) else np.full(n, float(model.bias > 0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            out += [score_rows(shared.value, rows, bins, b - a) for a, b, rows, bins in _terms(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """Scores for all rows, learned from labels outside fold ``held``."""
    found = predict(docs, fit(docs, labels, fold(folds) != held))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return found.select("doc_id", (fold(folds) == held).alias("held_out"), "score", predicted)
