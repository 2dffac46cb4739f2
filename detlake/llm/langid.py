"""Language of a text: multinomial naive Bayes over hashed character n-grams.

Runs of one to three letters, lower-cased and with one mark for whatever lies
between words, are hashed to ``BINS`` bins. The counts per language come from a
Spark job over a bounded sample of labelled rows (``PER_LANGUAGE`` rows each); the
matrix of log probabilities, ``BINS`` floats for each of at most
``sample.MAX_CLASSES`` languages, is broadcast, and texts are scored in batches.

Defined cases: null text, or no letter: ``und`` with score 0; no labelled row at
all: every text is ``und``; null ids are kept; equal rows get equal answers; ties
go to the language that sorts first; more than ``sample.MAX_CLASSES`` languages raise ``ValueError``;
other columns are not read (:func:`keep_known` keeps them). Memory follows the longest text.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from detlake.llm.sample import bounded, fold
from detlake.llm.text import add_by_row, code_points, pieces

BINS = 1 << 15
PER_LANGUAGE = 5000
SMOOTHING = 0.5
UNKNOWN = "und"
SLICE = 1 << 19  # bytes of text worked on at once; each becomes some sixty bytes of arrays


@functools.cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def grams(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams (three per letter), the row of each letter, and which rows have letters.

    Row by row: the bins have one line per letter or gap between words.
    """
    letter = _letters()[points]
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    keep = letter != 0
    keep[1:] |= letter[:-1] != 0
    keep |= first[:-1]
    letter, rows, first = letter[keep], rows[keep], first[:-1][keep]
    back = np.concatenate([letter[:1] * 0, letter[:-1]])
    back[first] = 0
    back2 = np.concatenate([back[:1] * 0, back[:-1]])
    back2[first] = 0
    one = letter * np.uint32(0x9E3779B1)
    two = one ^ (back * np.uint32(0x85EBCA77) + np.uint32(0x165667B1))
    three = two ^ (back2 * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
    bins = np.stack([one, two, three], axis=1)
    bins = ((bins ^ (bins >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    has = np.zeros(len(at) - 1, bool)
    has[rows[letter != 0]] = True
    return bins, rows, has


def _count_batches(batches):
    total: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for a, b, data, offsets in pieces(batch.column(1), SLICE):
            bins, rows, _ = grams(*code_points(data, offsets))
            names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
            flat = code[rows][:, None] * BINS + bins
            counts = np.bincount(flat.ravel(), minlength=len(names) * BINS).reshape(-1, BINS)
            for name, n, c in zip(names.tolist(), np.bincount(code, minlength=len(names)).tolist(), counts):
                total[name] = total.get(name, 0) + c
                texts[name] = texts.get(name, 0) + n
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        columns = [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)),
                   pa.array(np.append(counts[at], texts[name]))]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bin", "n"])


class Model:
    """Languages in order, their log priors and the ``BINS`` x languages log probabilities."""

    def __init__(self, langs: list[str], prior: np.ndarray, logp: np.ndarray):
        self.langs, self.prior, self.logp = langs, prior, logp


def fit(docs: DataFrame, train: Column | None = None, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from ``text`` and ``lang`` of the rows where ``train`` holds and both are there."""
    rows = docs.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    rows = rows if train is None else rows.filter(train)
    rows = bounded(rows, "lang", per_language).select("doc_id", "lang", "text").repartition(16, "doc_id")
    counts = rows.select("lang", "text").mapInArrow(_count_batches, "lang string, bin int, n bigint")
    found = counts.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs, code = np.unique(np.array(found["lang"].to_pylist(), dtype=object).astype(str), return_inverse=True)
    at, n = found["bin"].to_numpy(), found["n"].to_numpy()
    texts, matrix = np.zeros(len(langs)), np.zeros((BINS, len(langs)))
    texts[code[at < 0]] = n[at < 0]
    matrix[at[at >= 0], code[at >= 0]] = n[at >= 0]
    matrix += SMOOTHING
    logp = np.log(matrix / matrix.sum(axis=0, keepdims=True)).astype(np.float32)
    return Model(langs.tolist(), np.log(np.maximum(texts, 1) / max(texts.sum(), 1)), logp)


def _score(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of every text of a column."""
    names = np.array([*model.langs, UNKNOWN], object)
    pred, score = [names[:0]], [np.zeros(0)]
    for _, _, data, offsets in pieces(column, SLICE):
        bins, rows, has = grams(*code_points(data, offsets))
        total = np.tile(model.prior, (len(has), 1))
        best = np.full(len(has), len(model.langs))
        top = np.zeros(len(has))
        if model.langs:
            for i in range(0, len(rows), 1 << 17):
                part = bins[i:i + (1 << 17)]
                value = sum(model.logp[part[:, k]] for k in range(3))
                add_by_row(total, rows[i:i + (1 << 17)], value)
            best = np.where(has, total.argmax(axis=1), best)
            total -= total.max(axis=1, keepdims=True)
            top = np.where(has, 1 / np.exp(total).sum(axis=1), 0.0)
        pred.append(names[best])
        score.append(top)
    return np.concatenate(pred).tolist(), np.concatenate(score)


def _scorer(shared) -> Callable:
    def run(batches):
        for batch in batches:
            pred, score = _score(shared.value, batch.column(1))
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return run


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a letter and a language whose posterior is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            pred, score = _score(shared.value, batch.column(at))
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (posterior of that language) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared), f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Predictions for all rows, learned from rows outside fold ``held``; adds ``held_out``."""
    found = predict(docs, fit(docs, fold(folds) != held))
    return found.select("doc_id", (fold(folds) == held).alias("held_out"), "lang_pred", "score")
