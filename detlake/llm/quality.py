"""Quality grades: ordinal regression with cumulative links over hashed text.

A text has two blocks of hashed features: its words (lower case) and the shapes of
its words (runs of upper, lower, digit and sign classes, so ``###``, ``|`` and
shouting look alike in all languages). A feature's value is the square root of its
share of the block. All grades share one weight vector; ordered thresholds cut its
score: P(grade <= j) = sigmoid(threshold_j - score). From that come the expected
grade and the tail probability P(grade >= cut) used for selection.

The fit runs on the driver over a bounded sample, about ``PER_GRADE`` rated texts
of each grade, weighted back to the grades' shares. Grading is one pass without a
shuffle. Defined cases: null and empty texts have no features and get the grade
the thresholds give a score of zero; without ratings the grade is null and nothing
is selected; one grade only gives that grade; several ratings of a document count as
their mean, rounded; equal rows get equal grades; very long texts count whole; other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from detlake.llm.sample import bounded, fold
from detlake.llm.text import LOWER, SPACE, Words, hashes, pieces, words

BITS = 16
PER_GRADE = 3000
STEPS, RATE, DECAY = 150, 0.1, 1e-4

_CLASS = np.arange(256).astype(np.uint8)
_CLASS[[b for b in range(256) if 0x61 <= b <= 0x7A or b >= 0x80]] = ord("a")
_CLASS[[b for b in range(256) if 0x41 <= b <= 0x5A]] = ord("A")
_CLASS[[b for b in range(256) if 0x30 <= b <= 0x39]] = ord("0")


def _shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    """Class bytes with equal neighbours within a word merged to at most two, and their words."""
    kind = _CLASS[data]
    same = np.zeros(len(kind), bool)
    same[2:] = (kind[2:] == kind[1:-1]) & (kind[2:] == kind[:-2])
    edge = np.zeros(len(kind) + 2, bool)
    edge[offsets] = edge[offsets + 1] = True
    keep = ~same | edge[:-2]
    at = np.concatenate([[0], np.cumsum(keep)])
    return kind[keep], words(kind[keep], at[offsets])


def _features(column: pa.Array):
    """Pieces of the column with values of features: first row, end, rows, columns, values."""
    for a, b, data, offsets in pieces(column):
        rows, cols, values = [], [], []
        found = words(data, offsets)
        shapes, shaped = _shapes(data, offsets)
        blocks = ((hashes(data, found, LOWER), found), (hashes(shapes, shaped), shaped))
        for block, (h, of) in enumerate(blocks):
            pair = of.rows() * (1 << BITS) + (h >> np.uint64(64 - BITS)).astype(np.int64)
            pair, n = np.unique(pair, return_counts=True)
            row = pair >> BITS
            rows.append(row)
            cols.append((pair & ((1 << BITS) - 1)) + (block << BITS))
            values.append(np.sqrt(n / np.maximum(np.diff(of.row_at), 1)[row]).astype(np.float32))
        yield a, b, np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _feature_batches(batches):
    for batch in batches:
        cols, values = [None] * len(batch), [None] * len(batch)
        for a, b, row, col, value in _features(batch.column(2)):
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(b - a + 1))
            for i in range(b - a):
                here = order[cut[i]:cut[i + 1]]
                cols[a + i], values[a + i] = col[here].astype(np.int32), value[here]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cols, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))],
            ["grade", "weight", "cols", "vals"])


@dataclass
class Model:
    """Grades in order, ascending thresholds between them, weights."""

    grades: list[int]
    cuts: np.ndarray
    w: np.ndarray


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Ascending thresholds from free parameters: the first, then logs of the steps."""
    return np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit_features(grade: np.ndarray, weight: np.ndarray, rows, cols, values) -> Model:
    """Fit on texts given as (row, column, value) triples."""
    w = np.zeros(2 << BITS)
    grades, y = np.unique(grade, return_inverse=True)
    if len(grades) < 2:
        return Model(grades.tolist(), np.zeros(0), w)
    share, n = weight / weight.sum(), len(y)
    upto = np.cumsum([share[y == k].sum() for k in range(len(grades) - 1)])
    start = np.log(upto / (1 - upto))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    used, cols = np.unique(cols, return_inverse=True)
    v = np.zeros(len(used))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (v, raw)]
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, v[cols] * values, minlength=n)
        cuts = np.concatenate([[-np.inf], _cuts(raw), [np.inf]])
        top, low = _sigmoid(cuts[y + 1] - z), _sigmoid(cuts[y] - z)
        inside = np.maximum(top - low, 1e-12)
        d_top, d_low = top * (1 - top) / inside * share, low * (1 - low) / inside * share
        grad_v = np.bincount(cols, (d_top - d_low)[rows] * values, minlength=len(used)) + DECAY * v
        by_cut = np.array([d_low[y == k + 1].sum() - d_top[y == k].sum() for k in range(len(grades) - 1)])
        after = np.cumsum(by_cut[::-1])[::-1]
        grad_raw = np.concatenate([after[:1], after[1:] * np.exp(raw[1:])])
        for p, g, (m, s) in zip((v, raw), (grad_v, grad_raw), state):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    w[used] = v
    return Model(grades.tolist(), _cuts(raw), w)


def fit(docs: DataFrame, ratings: DataFrame, train: Column | None = None, per_grade: int = PER_GRADE) -> Model:
    """Learn ``grade`` (whole numbers) of ``ratings`` from the documents where ``train`` holds."""
    ratings = ratings.select("doc_id", "grade").filter("grade is not null")
    ratings = ratings if train is None else ratings.filter(train)
    ratings = ratings.groupBy("doc_id").agg(F.round(F.avg("grade")).cast("int").alias("grade"))
    chosen = F.broadcast(bounded(ratings, "grade", per_grade))  # about per_grade rows of each grade at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("grade", "weight", "text")
    kind = "grade int, weight double, cols array<int>, vals array<float>"
    found = rows.mapInArrow(_feature_batches, kind).toArrow()
    if not len(found):
        return Model([], np.zeros(0), np.zeros(2 << BITS))
    cols = found["cols"].combine_chunks()
    at = np.repeat(np.arange(len(found)), cols.value_lengths().to_numpy())
    values = found["vals"].combine_chunks().flatten().to_numpy()
    return fit_features(found["grade"].to_numpy(), found["weight"].to_numpy(), at, cols.flatten().to_numpy(), values)


def predict(docs: DataFrame, model: Model, cut: int) -> DataFrame:
    """``doc_id``, ``expected_grade`` and ``tail_prob`` = P(grade >= ``cut``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        steps = np.diff(m.grades)
        for batch in batches:
            grade, tail = [np.zeros(0)], [np.zeros(0)]
            for a, b, rows, cols, values in _features(batch.column(1)):
                z = np.bincount(rows, m.w[cols] * values, minlength=b - a)
                above = 1 - _sigmoid(m.cuts[None, :] - z[:, None])
                grade.append((m.grades[0] if m.grades else np.nan) + above @ steps)
                at = int(np.searchsorted(m.grades, cut))
                fixed = 1.0 if m.grades and at == 0 else 0.0
                tail.append(above[:, at - 1] if 0 < at < len(m.grades) else np.full(b - a, fixed))
            columns = [batch.column(0), pa.array(np.concatenate(grade), from_pandas=True), pa.array(np.concatenate(tail))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "expected_grade", "tail_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_prob double")


def select(docs: DataFrame, ratings: DataFrame, cut: int = 1, share: float = 0.5, folds: int = 5, held: int = 0) -> DataFrame:
    """Grades of all rows, learned outside fold ``held``; ``kept`` where the tail reaches ``share``."""
    found = predict(docs, fit(docs, ratings, fold(folds) != held), cut)
    return found.select("doc_id", (fold(folds) == held).alias("held_out"), "expected_grade", "tail_prob",
                        (F.col("tail_prob") >= share).alias("kept"))
