"""Benchmark passages in documents, by edit distance over words.

Items and document windows are embedded by the CGK random walk: at step ``j`` the
walk writes the word it stands on and moves on if bit ``j`` of that word's hash is
set. Windows within a few edits then agree in most places of the walk. A table
samples ``SAMPLES`` places of the walk of a window; windows that agree in all of
them with a window of an item are candidates, and ``TABLES`` independent tables
bring the recall up. Every word of every document starts a window of the item's
window size; a longer item is represented by windows that cover it end to end. A
document window leaves a table as soon as the places sampled so far fit no item,
which gives the same candidates as comparing whole samples.

Each candidate is then verified: the exact edit distance between the whole item
and its best matching passage near the candidate, at most ``EDITS`` of the item's
words.

Items are collected in blocks of ``BLOCK`` rows; the index of one block is
broadcast (a few hundred bytes per item), and documents are only scanned, without
a shuffle. Words are runs of letters and digits of the lower-cased text.

Defined cases: null and empty texts match nothing; items of fewer than ``LEAST``
words are no evidence and are left out; repeated items count once, repeated
documents each; ties go to the first passage; very long texts are worked on whole, alone; other
columns are not read; no items or no documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from detlake.llm.sample import free
from detlake.llm.text import NOT_ALNUM, hashes, mix, pieces, words

EDITS = 0.2
LEAST = 5
WINDOWS = (12, 5)  # window sizes in words; an item takes the largest that fits
SAMPLES = 4
TABLES = 6  # finds over 98 of 100 passages at the allowed number of edits, nearly all below
BLOCK = 20_000
_NONE = np.uint64(0)
_FILTER = 1 << 20


@dataclass
class Table:
    """Sampled places of one table and, per place, the keys of the items' windows."""

    number: int
    size: int
    places: list[int]
    keys: list[np.ndarray] = field(default_factory=list)
    seen: list[np.ndarray] = field(default_factory=list)
    window: np.ndarray | None = None


def _walk(table: Table, h: np.ndarray, start: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Walk from all ``start`` at once; ``keep(level, keys)`` says who goes on. Starts and keys left."""
    moved = np.zeros(len(start), np.int32)
    key, step = np.full(len(start), table.number + 1, np.uint64), 0
    for level, place in enumerate(table.places):
        for j in range(step, place):
            bit = np.uint64((11 * j + 23 * table.number) % 64)
            moved += ((h[start + moved] >> bit) & np.uint64(1)).astype(np.int32)
        step = place
        word = np.where(moved < table.size, h[start + moved], _NONE)
        key = (key ^ word) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
        on = keep(level, key)
        if on is not None:
            start, moved, key = start[on], moved[on], key[on]
    return start, key


@dataclass
class Index:
    """Items as word hashes, and the tables over their windows."""

    ids: pa.Array
    items: list[np.ndarray]
    tables: list[Table]
    owner: np.ndarray   # item of each window
    offset: np.ndarray  # where in the item each window begins


def tokens(column: pa.Array):
    """Pieces of the column: first row, end, word hashes with a 0 after each row, where rows begin."""
    for a, b, data, offsets in pieces(column):
        found = words(data, offsets, NOT_ALNUM)
        h = hashes(data, found)
        h[h == 0] = 1
        yield a, b, np.insert(h, found.row_at[1:], _NONE), found.row_at + np.arange(b - a + 1)


def build(ids: pa.Array, texts: pa.Array, n_tables: int = TABLES) -> Index:
    """Embed the items' windows and sample them into tables."""
    rows = [h[at[i]:at[i + 1] - 1] for _, _, h, at in tokens(texts) for i in range(len(at) - 1)]
    long = np.array([i for i, r in enumerate(rows) if len(r) >= LEAST], np.int64)
    index = Index(ids.take(pa.array(long)), [rows[i] for i in long], [], np.zeros(0, int), np.zeros(0, int))
    rng = np.random.default_rng(11)
    owners, offsets = [], []
    for size in WINDOWS:
        mine = [i for i, r in enumerate(index.items) if len(r) >= size and size == next(w for w in WINDOWS if len(r) >= w)]
        spots = [(i, o) for i in mine for o in sorted({*range(0, len(index.items[i]) - size + 1, size), len(index.items[i]) - size})]
        first = sum(map(len, owners))
        owners.append(np.array([i for i, _ in spots], np.int64))
        offsets.append(np.array([o for _, o in spots], np.int64))
        stride = 2 * size / SAMPLES
        for number in range(n_tables):
            places = [int(stride * k + rng.integers(0, int(stride))) for k in range(SAMPLES)]
            if not spots:
                continue
            table = Table(number, size, places)
            flat = np.concatenate([np.append(index.items[i][o:o + size], _NONE) for i, o in spots])

            def note(level, key, table=table):
                table.keys.append(np.unique(key))
                seen = np.zeros(_FILTER, bool)
                seen[(key >> np.uint64(40)) & np.uint64(_FILTER - 1)] = True
                table.seen.append(seen)

            start, key = _walk(table, flat, np.arange(len(spots)) * (size + 1), note)
            order = np.argsort(key, kind="stable")
            table.keys[-1], table.window = key[order], first + order
            index.tables.append(table)
    index.owner, index.offset = np.concatenate(owners), np.concatenate(offsets)
    return index


def candidates(index: Index, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, word where the item would begin) for all windows that agree with one of an item's in a table."""
    everywhere = np.flatnonzero(h != _NONE)
    items, begins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for table in index.tables:
        def keep(level, key, table=table):
            on = np.flatnonzero(table.seen[level][(key >> np.uint64(40)) & np.uint64(_FILTER - 1)])
            keys = table.keys[level]
            at = np.minimum(np.searchsorted(keys, key[on]), len(keys) - 1)
            return on[keys[at] == key[on]]

        start, key = _walk(table, h, everywhere, keep)
        low, high = np.searchsorted(table.keys[-1], key, "left"), np.searchsorted(table.keys[-1], key, "right")
        n = high - low
        windows = table.window[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        items.append(index.owner[windows])
        begins.append(np.repeat(start, n) - index.offset[windows])
    return np.concatenate(items), np.concatenate(begins)


def _distances(item: np.ndarray, texts: np.ndarray, free: bool) -> np.ndarray:
    """Edit distances of the item to all beginnings (``free``: to all passages ending there) of each text."""
    n = texts.shape[1]
    at = np.arange(n + 1, dtype=np.int32)
    row = np.zeros((len(texts), n + 1), np.int32) if free else np.tile(at, (len(texts), 1))
    for word in item:
        best = row + 1
        np.minimum(best[:, 1:], row[:, :-1] + (texts != word), out=best[:, 1:])
        row = np.minimum.accumulate(best - at, axis=1) + at
    return row


def verify(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least edit distance of the item to a passage of each text, and where that passage begins and ends."""
    last = _distances(item, texts, True)
    end = last.argmin(axis=1)
    back = np.zeros_like(texts)
    for e in np.unique(end):
        back[end == e, :e] = texts[end == e, :e][:, ::-1]
    length = _distances(item[::-1], back, False)
    length[np.arange(texts.shape[1] + 1)[None, :] > end[:, None]] = len(item) + texts.shape[1]
    return last.min(axis=1), end - length.argmin(axis=1), end


def _passages(index: Index, h: np.ndarray, row_at: np.ndarray, chunk: int = 2048):
    """Verified passages of a piece: (row, item, edits, first word, end) with the least edits per row and item."""
    item, begin = candidates(index, h)
    out = []
    for i in np.unique(item):
        words_of, slack = index.items[i], max(1, int(EDITS * len(index.items[i])))
        spot = np.unique(np.floor_divide(begin[item == i], slack)) * slack
        for k in range(0, len(spot), chunk):
            here = spot[k:k + chunk]
            # edits may place the item's beginning or end in a neighbouring text: those rows are looked at too
            middle = np.clip(here + len(words_of) // 2, 0, len(h) - 1)
            rows = np.unique(np.stack([np.searchsorted(row_at, np.clip(p, 0, len(h) - 1), "right") - 1
                                       for p in (here, middle, here + len(words_of))], 1), axis=1)
            pairs = np.unique(np.stack([np.repeat(here, rows.shape[1]), rows.ravel()], 1), axis=0)
            low, high = row_at[pairs[:, 1]], row_at[pairs[:, 1] + 1] - 1
            span = np.arange(len(words_of) + 4 * slack)
            at = pairs[:, :1] - slack + span[None, :]
            inside = (at >= low[:, None]) & (at < high[:, None])
            texts = np.where(inside, h[np.clip(at, 0, len(h) - 1)], _NONE)
            edits, start, end = verify(words_of, texts)
            for j in np.flatnonzero(edits <= EDITS * len(words_of)):
                base = pairs[j, 0] - slack - low[j]
                out.append((int(pairs[j, 1]), int(i), int(edits[j]), int(max(base + start[j], 0)), int(base + end[j])))
    best: dict[tuple[int, int], tuple] = {}
    for found in sorted(out, key=lambda f: (f[0], f[1], f[2], f[3])):
        best.setdefault(found[:2], found)
    return list(best.values())


def _found(index: Index, column: pa.Array) -> list[tuple]:
    """Passages of all rows of a column: (row, item, edits, first word, end)."""
    return [(a + r, *rest) for a, _, h, row_at in tokens(column) for r, *rest in _passages(index, h, row_at)]


def _indexes(benchmark: DataFrame, n_tables: int):
    """Broadcast indexes of all blocks of the benchmark."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", F.lower("text").alias("text")).filter("text is not null").distinct()
    blocks = max(1, -(-items.count() // BLOCK))
    for b in range(blocks):
        found = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        ids, texts = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in found.columns)
        yield spark.sparkContext.broadcast(build(ids, texts, n_tables))


def contaminated(docs: DataFrame, benchmark: DataFrame, n_tables: int = TABLES) -> DataFrame:
    """One row per document row and benchmark item whose passage it holds, with the least edits.

    Columns: ``doc_id``, ``item_id``, ``edits``, ``item_words``, ``first_word``, ``end_word``.
    """
    def scan(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                found = _found(index, batch.column(1))
                row, item, edits, start, end = (np.array(c, np.int64) for c in (zip(*found) if found else [[]] * 5))
                n = np.array([len(index.items[i]) for i in item], np.int64)
                columns = [batch.column(0).take(pa.array(row)), index.ids.take(pa.array(item)),
                           *(pa.array(c) for c in (edits, n, start, end))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "item_words", "first_word", "end_word"])

        return run

    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, edits bigint, item_words bigint, first_word bigint, end_word bigint"
    rows = docs.select("doc_id", F.lower("text").alias("text"))
    return reduce(DataFrame.unionByName, [rows.mapInArrow(scan(s), schema) for s in _indexes(benchmark, n_tables)])


def keep_clean(docs: DataFrame, benchmark: DataFrame, n_tables: int = TABLES) -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark; other columns may have any names."""
    (lower,) = free(docs, "lower")

    def drop(shared):
        def run(batches):
            for batch in batches:
                bad = np.zeros(len(batch), bool)
                bad[[f[0] for f in _found(shared.value, batch.column(batch.num_columns - 1))]] = True
                yield batch.drop_columns([lower]).filter(pa.array(~bad))

        return run

    for shared in _indexes(benchmark, n_tables):
        docs = docs.withColumn(lower, F.lower("text")).mapInArrow(drop(shared), docs.schema)
    return docs
