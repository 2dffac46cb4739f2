"""Near-duplicate passages across documents, found by compact windows.

A document is its sequence of five-word shingles. Under one hash function every run
of shingles has one minimum, and the runs whose minimum stands at place ``c`` are
those that contain ``c`` and stay inside the subtree of ``c`` in the Cartesian tree of
the hashes: one compact window ``(left, c, right)`` stands for all of them. Only
windows that hold a run of the least length are kept, about two per ``LEAST`` words
and hash function. Windows of different documents with the same minimum are put
side by side; where the parts they have in common are long enough, the documents
are a candidate pair, and ``AGREE`` of ``HASHES`` functions must
say so. Both documents are then compared exactly: maximal stretches
whose shingle sets have a Jaccard similarity of ``SIMILAR`` or more are reported.

Texts that are equal as a whole are told apart from all others first, by their hashes, and
only the first document of each goes on.

A minimum shared by many documents links each of them to the first document that
holds it and to the one before, never all to all: every later copy has a link to an
earlier one. The first holder may share no more than those five words. All documents are
therefore linked again under finer keys, of which ``FINER`` must agree: the whole run of ``LEAST`` words, which finds
an earlier holder of every exact repeat whatever else shares parts of it, and, for
repeats with edits, a minimum together with the minimum of another function over the
``SIDE`` shingles on its left or right. Rows of a batch with the same key are linked
before the shuffle and only those of the first document are sent on, so a passage in
a large share of all documents does not make a large group. A candidate pair is
compared over both whole texts, so what is found does not rest on where it was linked.

Words are split at white space, A-Z lower-cased. Documents are ordered by
``doc_id``, a whole number (``TypeError`` otherwise); the later document of a pair carries the duplicate.
Defined cases: null, empty and short texts (under ``LEAST`` words) have no passages;
rows without id are left alone; rows that share an id are never compared with each
other; repeats inside one document are not looked for; other columns are not read (:func:`cut_repeats`
keeps them); no rows give no rows. Texts
over ``CUT`` shingles are worked on in parts that overlap by ``OVERLAP``.
"""

from __future__ import annotations

import functools
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from detlake.llm.sample import free
from detlake.llm.text import LOWER, _powers, buffers, hashes, mix, pieces, runs, words
from detlake.session import materialize

SHINGLE = 5
LEAST = 50
HASHES = 4
AGREE = 2
FINER = 1  # functions that must agree under the finer keys, which hold two minima each
SIMILAR = 0.8
RUN = LEAST - SHINGLE + 1
SIDE = RUN // 2  # a run of RUN shingles has so many on one side of any of its places
CUT, OVERLAP = 1 << 18, 1 << 12
BITS = 1 << 26  # 8 MB; more ids than that let more documents through, never fewer
EXACT = 7  # in place of the function: the key is that of a whole run
SHARED = 1 << 62  # in place of what windows said: a minimum that several documents hold
SLICE = 1 << 22  # bytes of text worked on at once
ROWS = 1000  # documents that go to Python at once
GAPS = (2 * SHINGLE, SHINGLE, 0)

_PLACE = np.uint64((1 << 20) - 1)
_FAR = (1 << 16) - 1
_SEEDS = np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of a run of rows and where each row's begin."""
    found = words(data, offsets)
    return runs(hashes(data, found, LOWER), found.row_at, SHINGLE)


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` values from each place on."""
    span = 1
    out = values
    while 2 * span <= size:
        out, span = np.minimum(out[:-span], out[span:]), 2 * span
    return np.minimum(out[:len(values) - size + 1], out[size - span:])


def compact_windows(values: np.ndarray, at: np.ndarray, far: int | None = None, held=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum's place, left and right end (inclusive) of all windows that hold a run of ``RUN`` values.

    ``values`` are hashes of all rows one after the other, ``at`` where rows begin; at
    most 2**20 values. Equal minima: the leftmost counts. ``far``: ends further away than that may be
    told nearer, but not nearer than that. ``held``: says of places whether their windows are wanted.
    """
    n = len(values)
    if n < RUN:
        return (np.zeros(0, np.int64),) * 3
    g = (values & ~_PLACE) | np.arange(n, dtype=np.uint64)
    size = np.diff(at).max(initial=1)
    size, tables = size if far is None else min(size, far), [g]
    while 2 ** len(tables) <= max(size, RUN):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    wide = RUN.bit_length() - 1
    least = np.minimum(tables[wide][:n - RUN + 1], tables[wide][RUN - 2**wide:])
    whole = np.ones(n, bool)
    ends = np.clip(at[1:, None] - np.arange(1, RUN)[None, :], at[:-1, None], None)
    some = at[1:] > at[:-1]
    whole[ends[some].ravel()] = False
    c = (least[whole[:len(least)]] & _PLACE).astype(np.int64)
    c = c[np.append(True, c[1:] != c[:-1])[:len(c)]]
    c = c if held is None else c[held(c)]
    row = np.searchsorted(at, c, "right") - 1
    first, last, own = at[row], at[row + 1], g[c]
    left, right = c.copy(), c + 1
    for k in range(len(tables) - 1, -1, -1):
        step, top = 1 << k, len(tables[k]) - 1
        to = left - step
        left = np.where((to >= first) & (tables[k][np.clip(to, 0, top)] > own), to, left)
        to = right + step
        right = np.where((to <= last) & (tables[k][np.clip(right, 0, top)] > own), to, right)
    return c, left, right - 1


def _parts(at: np.ndarray):
    """Row, first and end shingle of what is worked on at once: whole rows, or parts of very long ones."""
    for i in range(len(at) - 1):
        start = at[i]
        while at[i + 1] - start > CUT:
            yield i, start, start + CUT
            start += CUT - OVERLAP
        yield i, start, at[i + 1]


def _sides(least: np.ndarray, first: np.ndarray, end: np.ndarray, c: np.ndarray):
    """Which places have ``SIDE`` values of their row on the left, then right, and the least hash there.

    ``least``: that of ``SIDE`` hashes from each place on.
    """
    for low in (c - SIDE, c + 1):
        on = np.flatnonzero((low >= first) & (low + SIDE <= end))
        yield on, least[low[on]]


def _jobs(column: pa.Array, doc: np.ndarray):
    """Shingles worked on at once: values, where rows begin, their documents, and how far into the text each row is."""
    for a, b, data, offsets in pieces(column, 1 << 20):  # below 2**20 words
        sh, at = shingles(data, offsets)
        if b - a == 1 and len(sh) > CUT:
            for i, s, e in _parts(at):
                yield sh[s:e], np.array([0, e - s]), doc[a + i:a + i + 1], np.array([s - at[i]])
        else:
            yield sh, at, doc[a:b], np.zeros(b - a, np.int64)


def _key(minima: np.ndarray, f: int) -> np.ndarray:
    return mix(minima + np.uint64(f)) & ~np.uint64(7) | np.uint64(f)


def _wanted(values: np.ndarray, f: int, among):
    """Whether the minima at places are in the set of shared ones; all are wanted if there is none."""
    return None if among is None else lambda c: _in(among, _place_of(_key(values[c], f)))


def _windows(column: pa.Array, doc: np.ndarray, sides: bool = False, functions: int = HASHES, among=None):
    """Windows of a batch: key (function in the low bits), document, place and reach packed in 64 bits.

    ``among``: set of the minima whose windows are wanted.
    """
    keys, docs, spots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for values, starts, ids, shift in _jobs(column, doc):
        least = _least(mix(values ^ np.uint64(0x5851F42D4C957F2D)), SIDE) if sides and len(values) >= RUN else values
        for f in range(functions):
            c, left, right = compact_windows(mix(values + _SEEDS[f]), starts, RUN, _wanted(values, f, among))
            row = np.searchsorted(starts, c, "right") - 1
            key = _key(values[c], f)
            place = c - starts[row] + shift[row]
            reach = np.minimum(c - left, _FAR) << 16 | np.minimum(right - c, _FAR)
            spot, found = place << 32 | reach, [(np.arange(len(c)), key)]
            if sides:
                near = enumerate(_sides(least, starts[row], starts[row + 1], c))
                found = [(on, mix(key[on] + mix(least) + np.uint64(8 * k)) & ~np.uint64(7) | np.uint64(f)) for k, (on, least) in near]
            for on, own in found:
                keys.append(own.view(np.int64))
                docs.append(ids[row[on]])
                spots.append(spot[on])
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(spots)


def _exact_runs(column: pa.Array, doc: np.ndarray, among):
    """Windows keyed by all values of a run: one for each run whose minimum under the first function is in the set."""
    keys, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for values, starts, ids, _ in _jobs(column, doc):
        c, left, right = compact_windows(mix(values + _SEEDS[0]), starts, RUN, _wanted(values, 0, among))
        low, high = np.maximum(left, c - RUN + 1), np.minimum(c, right - RUN + 1)
        size = high - low + 1
        begin = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
        power, inverse = _powers(1 << max(18, len(values).bit_length()))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values) * power[:len(values)], out=sums[1:])
        key = mix((sums[begin + RUN] - sums[begin]) * inverse[begin]) | np.uint64(EXACT)
        keys.append(key.view(np.int64))
        docs.append(np.repeat(ids[np.searchsorted(starts, c, "right") - 1], size))
    key = np.concatenate(keys)
    return key, np.concatenate(docs), np.full(len(key), _FAR << 16 | _FAR)


def _place_of(key: np.ndarray) -> np.ndarray:
    """Places of minima in a set of shared ones; each function has ``BITS`` of its own."""
    return (key >> np.uint64(3)).astype(np.int64) % BITS + (key & np.uint64(7)).astype(np.int64) * BITS


def _in(among, at: np.ndarray) -> np.ndarray:
    return among.value[at >> 3] >> (7 - (at & 7)) & 1 == 1


def _linked(key, first, doc, first_spot, spot) -> tuple:
    """Columns of the pairs whose windows have a run in common: documents, function."""
    x = np.minimum(first_spot >> 16 & _FAR, spot >> 16 & _FAR)
    y = np.minimum(first_spot & _FAR, spot & _FAR)
    on = (x + y + 1 >= SIMILAR * RUN) & (first != doc)
    said = np.int64(1) << (key[on] & 7)
    return first[on], doc[on], np.where(said == 1 << EXACT, (1 << AGREE) - 1 << EXACT, said)


_COLUMNS = ["key", "a", "b", "spot", "said"]
_SCHEMA = ", ".join(f"{c} bigint" for c in _COLUMNS)


def _batch(key, a, b, spot, said) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, a, b, spot, said)], _COLUMNS)


def _links_batch(a, b, said) -> pa.RecordBatch:
    """Links, each pair of documents once with all that its windows said."""
    order = np.lexsort((b, a))
    a, b, said = a[order], b[order], said[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)])
    said = np.bitwise_or.reduceat(said, start) if len(a) else said
    a, b = a[start], b[start]
    return _batch(mix(a.view(np.uint64) ^ mix(b.view(np.uint64))).view(np.int64), a, b, np.zeros(len(a), np.int64), said)


def _widest(key: np.ndarray, doc: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by key and document, without places whose reach another place of that key and document has on both sides."""
    left, right = np.minimum(spot >> 16 & _FAR, RUN), np.minimum(spot & _FAR, RUN)  # more says no more
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    at = np.flatnonzero(np.append(same, False) | np.append(False, same))[:len(key)]  # most keys stand alone
    some = order[at]
    order[at] = some[np.lexsort((-right[some], -left[some], doc[some], key[some]))]
    key, doc, spot, right = key[order], doc[order], spot[order], right[order]
    own = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[:len(key)]
    group = np.cumsum(own) << 17
    best = np.maximum.accumulate(group + right)  # of the places with at least that reach to the left
    kept = own | (group + right > np.append(0, best)[:len(key)])
    return key[kept], doc[kept], spot[kept]


def _grouped(key: np.ndarray, doc: np.ndarray, spot: np.ndarray):
    """Rows as :func:`_widest` leaves them: which are of each key's first document, and the links to it and to the document before.

    Every place of a document is held against every place of those two.
    """
    n = len(key)
    start = np.append(True, key[1:] != key[:-1])[:n]
    own = start | np.append(True, doc[1:] != doc[:-1])[:n]
    at = np.append(np.flatnonzero(own), n)  # where each key and document begins
    group = np.cumsum(own) - 1
    head = np.maximum.accumulate(np.where(start, group, 0)) if n else group
    rest = np.flatnonzero(group != head)
    out = [(np.zeros(0, np.int64),) * 3]
    near = rest[key[rest] & 7 != EXACT]  # who holds all of a run is like every other
    for rest, to in ((rest, head[rest]), (near, group[near] - 1)):
        size = at[to + 1] - at[to]
        row = np.repeat(rest, size)
        other = np.repeat(at[to] - np.cumsum(size) + size, size) + np.arange(size.sum())
        out.append(_linked(key[row], doc[other], doc[row], spot[other], spot[row]))
    return group == head, [np.concatenate(c) for c in zip(*out)]


def _bits(ids: DataFrame, place=None, size: int = BITS):
    """Broadcast set of document ids as ``size`` bits at hashed places: may hold others, misses none."""
    place = F.pmod(F.xxhash64("_id"), F.lit(BITS)) if place is None else place
    rows = ids.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("part"))
    out = np.zeros(size // 8, np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("m")).collect():  # size / 8 bytes at most
        bits = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
        out[r["part"] * 4096:(r["part"] + 1) * 4096] = np.packbits(bits)
    return ids.sparkSession.sparkContext.broadcast(out)


def _minima(only=None):
    """Minima under the first function and the least and greatest document of the batch that holds each."""
    def run(batches):
        for batch in batches:
            batch = batch if only is None else _held(batch, only, 2)
            key, doc, _ = _windows(batch.column(1), batch.column(0).to_numpy(), functions=1)  # one in 20 words
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
            end = np.append(start[1:], len(key)) - 1 if len(key) else start
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[start], doc[start], doc[end])], ["key", "a", "b"])

    return run


def _shared_minima(rows: DataFrame, only=None):
    """Set of the minima that more than one document holds."""
    found = rows.mapInArrow(_minima(only), "key bigint, a bigint, b bigint").groupBy("key").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return _bits(found.filter("a < b"), F.expr(f"shiftrightunsigned(key, 3) % {BITS}"))


def _held(batch: pa.RecordBatch, among, place: int) -> pa.RecordBatch:
    """The rows whose place is in the set."""
    return batch.filter(pa.array(_in(among, batch.column(place).to_numpy())))


def _marks(key: np.ndarray, doc: np.ndarray, functions: int) -> pa.RecordBatch:
    """Rows for the places of minima under the first functions that more than one document holds; they stand as both ends."""
    more = (key[1:] == key[:-1]) & (doc[1:] != doc[:-1]) & (key[1:] & 7 < functions)
    place = np.unique(_place_of(key[1:][more].view(np.uint64)))
    return _batch(mix(place.view(np.uint64)).view(np.int64), place, place, np.zeros(len(place), np.int64), np.full(len(place), SHARED))


def _emit(windows, only=None, limit=SLICE, marks=0):
    """Windows to compare across batches, told by ``said`` = 0, and the links within the batch.

    Of each key all places of the first document of a slice go on. ``only``: set of the documents to
    work on; ``limit``: bytes of text worked on at once; ``marks``: of how many functions to tell shared minima too (:func:`_marks`).
    """
    def run(batches):
        for batch in batches:
            batch = batch if only is None else _held(batch, only, 2)
            for a, b in [(p[0], p[1]) for p in pieces(batch.column(1), limit)]:
                part = batch.slice(a, b - a)
                key, doc, spot = _widest(*windows(part.column(1), part.column(0).to_numpy()))
                first, links = _grouped(key, doc, spot)
                zero = np.zeros(first.sum(), np.int64)
                yield _batch(key[first], doc[first], zero, spot[first], zero)
                yield _links_batch(*links)
                if marks:
                    yield _marks(key, doc, marks)

    return run


def _compare(batches, marks=0):
    """Links between windows of equal key; rows come sorted by key and document. Links and marks pass through."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        link = columns[-1] != 0
        yield _batch(*(c[link] for c in columns))
        key, doc, spot = _widest(*(np.concatenate([h, columns[i][~link]]) for h, i in zip(held, (0, 1, 3))))
        if len(key):
            first, links = _grouped(key, doc, spot)
            yield _links_batch(*links)
            if marks:
                yield _marks(key, doc, marks)
            last = (key == key[-1]) & (first | (doc == doc[-1]))
            held = [key[last], doc[last], spot[last]]


def _rows(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id is {kind.simpleString()}, but documents are ordered by a whole number")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return rows.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)))


def _pairs(rows: DataFrame, windows, only=None, limit=SLICE, agree=AGREE, marks=0) -> DataFrame:
    found = rows.mapInArrow(_emit(windows, only, limit, marks), _SCHEMA).repartition("key").sortWithinPartitions("key", "a")
    found = found.mapInArrow(functools.partial(_compare, marks=marks), _SCHEMA).groupBy("a", "b").agg(F.bit_or("said").alias("said"))
    return found.filter((F.bit_count("said") >= agree) | (F.col("said") == SHARED)).drop("said")


def candidate_pairs(docs: DataFrame, sides: bool = False, only=None, marks: int = 0, among=None) -> DataFrame:
    """Pairs ``a < b`` of documents that have windows in common.

    With ``sides`` the minima are keyed together with what stands beside them. ``only``: set of the
    documents that count (:func:`_bits`). With ``marks`` there are rows ``a = b`` besides: the places of the
    minima under that many functions that several documents hold, as all windows meet by their minima here anyway.
    ``among``: set of those of all functions, if it is known; no others can link documents.
    """
    windows = lambda column, doc: _windows(column, doc, sides, among=among)
    return _pairs(_rows(docs), windows, only, agree=FINER if sides else AGREE, marks=marks)


def exact_pairs(docs: DataFrame, only=None, among=None) -> DataFrame:
    """Pairs ``a < b`` so that every document is with an earlier holder of each run of ``LEAST`` words it repeats.

    The key is the run itself, so chance holders of a part of it do not stand between;
    runs whose minimum only one document holds are left out in the scan. ``among``: set of the shared
    minima, if it is known.
    """
    rows = _rows(docs)
    among = _shared_minima(rows, only) if among is None else among
    return _pairs(rows, lambda column, doc: _exact_runs(column, doc, among), only, SLICE // 2)


def _stretches(hit: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """Stretches of hits with at most ``gap`` misses in a row, as long as a least run can be."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(at[1:] - at[:-1] > gap + 1)
    pairs = zip([at[0].item(), *at[cut + 1].tolist()], [*at[cut].tolist(), at[-1].item()])
    return [(s, e + 1) for s, e in pairs if e + 1 - s >= SIMILAR * RUN]


def _blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs that ``x`` and ``y`` hold alike: where they begin in both and their lengths, in order of ``y``."""
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    low, high = ordered.searchsorted(y, "left"), ordered.searchsorted(y, "right")
    hit = np.flatnonzero(high > low)
    total = np.cumsum((high - low)[hit])
    out = [(np.zeros(0, np.int64),) * 3]
    for part in np.split(hit, np.flatnonzero(np.diff(total >> 22)) + 1) if len(hit) else []:  # a bounded number of meetings at once
        size = (high - low)[part]
        j = np.repeat(part, size)
        i = order[np.repeat(low[part] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        by = np.lexsort((j, i - j))
        i, j = i[by], j[by]
        start = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1))[:len(i)])
        out.append((i[start], j[start], np.diff(np.append(start, len(i)))))
    i, j, n = (np.concatenate(c) for c in zip(*out))
    by = np.lexsort((i, j))
    return i[by], j[by], n[by]


def _followers(i: np.ndarray, j: np.ndarray, n: np.ndarray, far: int) -> list[int]:
    """For each block the nearest that follows it in both texts, at most ``far`` places away; -1: none.

    All blocks look at their next ones in ``y``, then at more of those after them, as long as they
    could still be nearer.
    """
    i_end, j_end = i + n, j + n
    out, best = np.full(len(i), -1), np.full(len(i), far + 1)
    at, other, many = np.arange(len(i)), j.searchsorted(j, "right"), 2
    while True:
        on = other < len(i)
        on[on] = (j[other[on]] - j_end[at[on]]) < best[at[on]]
        at, other = at[on], other[on]
        if not len(at):
            return out.tolist()
        many = max(1, min(2 * many, (1 << 16) // len(at)))
        next_ones, own = other[:, None] + np.arange(many), at[:, None]
        o = np.minimum(next_ones, len(i) - 1)
        good = (next_ones < len(i)) & (i[o] > i[own]) & (i_end[o] > i_end[own]) & (j_end[o] > j_end[own])
        apart = np.where(good, np.maximum(np.abs(i[o] - i_end[own]), np.abs(j[o] - j_end[own])), far + 1)
        first = apart.argmin(axis=1)
        apart = apart[np.arange(len(at)), first]
        good = apart < best[at]
        out[at[good]], best[at[good]] = (other + first)[good], apart[good]
        other = other + many


class _Pair:
    """Two texts as small numbers, one for each different shingle of either."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        own, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
        self.x, self.y, self.kinds = codes[:len(x)], codes[len(x):], len(own)

    def marks(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(self.kinds, bool)
        out[codes] = True
        return out

    @functools.cached_property
    def firsts(self) -> np.ndarray:
        """How many different shingles of ``x`` are met for the first time before each place, and at its end."""
        first = np.full(self.kinds, len(self.x))
        first[self.x[::-1]] = np.arange(len(self.x))[::-1]
        out = np.zeros(len(self.x) + 2, np.int64)
        out[first + 1] = 1  # those of ``y`` alone behind the end
        return np.cumsum(out[:-1])

    def nearest(self, likes: set[tuple[int, int]], s: int, e: int, own: np.ndarray) -> tuple[float, int, int]:
        """Similarity and ends of the range of ``x`` most like one of ``y``, whose ``own`` marks these are; 0 if under ``SIMILAR``.

        Only ranges are compared whose places that the one of ``y`` knows could be enough.
        """
        f, t = np.array(sorted(likes), np.int64).reshape(-1, 2).T
        kinds, held = np.count_nonzero(own), np.append(0, np.cumsum(own[self.x]))
        both = np.minimum(held[t] - held[f], kinds)  # at most
        on = both / (np.maximum(self.firsts[t] - self.firsts[f], both) + kinds - both) >= SIMILAR
        good = [(self.likeness(f, t, s, e), -f, f, t) for f, t in zip(f[on].tolist(), t[on].tolist())]
        share, _, f, t = max(good, default=(0, 0, 0, 0))
        return share, f, t

    def likeness(self, f: int, t: int, s: int, e: int) -> float:
        """Jaccard similarity of a range of ``x`` and one of ``y``."""
        if t - f + e - s > self.kinds >> 3:
            one, two = self.marks(self.x[f:t]), self.marks(self.y[s:e])
            both = np.count_nonzero(one & two)
            return both / (np.count_nonzero(one) + np.count_nonzero(two) - both)
        one, two = set(self.x[f:t].tolist()), set(self.y[s:e].tolist())
        both = len(one & two)
        return both / (len(one) + len(two) - both)


def _chained(pair: _Pair, i: np.ndarray, j: np.ndarray, n: np.ndarray, far: int):
    """From each block the longest similar stretch that ends with a block after it, unless an earlier one holds it or is as good."""
    follows = _followers(i, j, n, far)
    i, j, n = i.tolist(), j.tolist(), n.tolist()
    ends: dict[int, int] = {}  # block a stretch ends with and where the first such stretch begins
    reach, since, best = -1, -1, 0.0  # the furthest end of a stretch so far, the first place where one begins that ends there, its share
    for p in range(len(i)):
        both, q, good = 0, p, []
        while q >= 0:
            both += n[q]
            long, other = j[q] + n[q] - j[p], i[q] + n[q] - i[p]
            if long - both > far:  # more misses than all hits allow
                break
            if long >= RUN and both >= SIMILAR * (long + other - both):
                good.append(q)
            q = follows[q]
        for q in reversed(good):
            if q in ends:  # inside a stretch found before, and so are all before it
                break
            f, t, s, e = i[p], i[q] + n[q], j[p], j[q] + n[q]
            if e < reach or (e == reach and (since < s or best == 1)):  # inside another stretch, and so are all before it
                break
            share = pair.likeness(f, t, s, e)
            if share >= SIMILAR:
                yield f, t, s, e, share
                ends[q] = p
                if e > reach or s == since:
                    reach, since, best = e, s, share if e > reach else max(best, share)
                break


def similar_stretches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """Stretches of ``y`` and their likes in ``x``: both ranges and the similarity of their sets, 0.8 or more.

    First all that the texts share, then each stretch of hits, is held against the part of ``x`` between its
    first and last like. What is not similar that way is joined from runs alike in both texts while the
    whole stays similar, and its stretches are held against those of ``x`` too, of their own
    shingles and of all, as parts may be in another order.
    """
    pair = _Pair(x, y)
    in_x, left = pair.marks(pair.y)[pair.x], pair.marks(pair.x)[pair.y]
    if np.count_nonzero(left) < SIMILAR * RUN:
        return []
    ends = lambda hit: (int(hit.argmax()), len(hit) - int(hit[::-1].argmax()))
    (f, t), (s, e), found = ends(in_x), ends(left), []
    share = pair.likeness(f, t, s, e) if e - s >= RUN else 0.0
    if share >= SIMILAR:
        return [(f, t, s, e, share)]
    for s, e in _stretches(left, GAPS[0]):
        if e - s >= RUN:
            f, t = ends(pair.marks(pair.y[s:e])[pair.x])
            share = pair.likeness(f, t, s, e)
            if share >= SIMILAR:
                found.append((f, t, s, e, share))
                left[s:e] = False
    hits = min(int(np.count_nonzero(in_x)), int(np.count_nonzero(left)))
    if np.count_nonzero(left) >= SIMILAR * RUN:
        found += _chained(pair, *_blocks(pair.x, np.where(left, pair.y, -1)), hits // 4 + SHINGLE)
    for gap in GAPS:
        others = None
        for s, e in _stretches(left, gap):
            if e - s < RUN or any(f <= s and e <= t for _, _, f, t, _ in found):
                continue
            others = _stretches(in_x, gap) if others is None else others
            own = pair.marks(pair.y[s:e])
            share, f, t = pair.nearest({*others, *_stretches(own[pair.x], gap)}, s, e, own)
            if share >= SIMILAR:
                found.append((f, t, s, e, share))
    out: list[tuple[int, int, int, int, float]] = []
    for new in sorted(found, key=lambda r: (r[2] - r[3], -r[4], r[2], r[0])):
        if not any(s <= new[2] and new[3] <= e for _, _, s, e, _ in out):
            out.append(new)
    return out


def _different(column: pa.Array) -> tuple[list[np.ndarray], list[int]]:
    """Shingles of all different texts of a column, and which of them each row has: a text stands in many pairs."""
    coded = column.dictionary_encode()
    _, at = found = shingles(*buffers(coded.dictionary))
    return np.split(found[0], at[1:-1]), coded.indices.to_pylist()


def _verify(batches):
    names = ["doc_id", "first_word", "end_word", "other_id", "other_first", "other_end", "similarity", "text_id"]
    for batch in batches:
        rows, tail = [], SHINGLE - 1
        ids, others, text_ids = (batch.column(c).to_pylist() for c in (1, 0, 3))
        for a, b, _, _ in pieces(batch.column(4)):
            y, y_row = _different(batch.column(4).slice(a, b - a))
            earlier = batch.column(2).slice(a, b - a)
            for c, d, _, _ in pieces(earlier):
                x, x_row = _different(earlier.slice(c, d - c))
                for k in range(c, d):
                    i = a + k
                    for f, t, s, e, share in similar_stretches(x[x_row[k - c]], y[y_row[k]]):
                        rows.append((ids[i], s, e + tail, others[i], f, t + tail, share, text_ids[i]))
        kinds = [pa.int64()] * 6 + [pa.float64(), pa.int64()]
        columns = zip(*rows) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back, and the shuffle files it needed let go.

    Windows and texts are each shuffled once and then of no use, but Spark keeps such
    files until the driver collects its garbage; so the disk holds one step at a time.
    While it is written, Python gets ``ROWS`` rows at once, as a batch is held by the
    executor and its worker both; the session's own setting is put back.
    """
    conf, name_of = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name_of)
    conf.set(name_of, str(ROWS))
    try:
        table = materialize(df, f"passages-{name}")
    finally:
        conf.set(name_of, before)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return table


def _compared(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The similar stretches of stored candidate pairs, whole texts against each other.

    Only texts of these pairs are shuffled (:func:`_bits`), as texts: hashes of their shingles are larger and do not
    compress. Rows that share an id are each compared.
    """
    among = _bits(pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct())
    texts = _rows(docs).select("doc_id", F.xxhash64("text").alias("text_id"), "text", "place")
    texts = texts.mapInArrow(lambda batches: (_held(b, among, 3) for b in batches), texts.schema).drop("place")
    earlier = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    both = pairs.join(earlier, "a").join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "b", "x", "text_id", "text")
    schema = ("doc_id bigint, first_word bigint, end_word bigint, other_id bigint, other_first bigint, "
              "other_end bigint, similarity double, text_id bigint")
    return both.mapInArrow(_verify, schema).distinct()


def _copies(docs: DataFrame) -> tuple[DataFrame, object]:
    """Whole copies of texts of ``LEAST`` words, as passages of the first document with that text, and the set of those first ones.

    Texts count as equal where two 64-bit hashes and their numbers of words do.
    """
    words_in = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    texts = _rows(docs).select("doc_id", F.xxhash64("text").alias("text_id"), F.xxhash64(F.lit(1), "text").alias("also"), words_in.alias("n"))
    texts = _stored(texts, "texts")
    key = ["text_id", "also", "n"]
    first = _stored(texts.groupBy(*key).agg(F.min("doc_id").alias("other_id"), F.max("doc_id").alias("last")), "texts")
    found = texts.join(first.filter(f"last > other_id and n >= {LEAST}").drop("last"), key).filter("doc_id > other_id")
    zero = F.lit(0).cast("bigint")
    found = found.select("doc_id", zero.alias("first_word"), F.col("n").alias("end_word"), "other_id", zero.alias("other_first"),
                         F.col("n").alias("other_end"), F.lit(1.0).alias("similarity"), "text_id").distinct()
    return found, _bits(first.select(F.col("other_id").alias("_id")))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of a document that an earlier document holds too, one row per passage and earlier document found.

    Columns: ``doc_id``, ``first_word``, ``end_word`` (excluded), ``other_id``, ``other_first``,
    ``other_end``, ``similarity``, ``text_id`` (xxhash64 of the text the words are counted in).

    A later copy of a whole text is one passage of the first document with that text, which alone
    stands for the text in what follows.
    """
    copies, only = _copies(docs)
    pairs = _stored(candidate_pairs(docs, only=only, marks=HASHES), "pairs")
    among, pairs = _bits(pairs.filter("a = b"), F.col("a"), HASHES * BITS), pairs.filter("a <> b")
    found = _stored(_compared(docs, pairs), "found")
    new = lambda more, *known: functools.reduce(lambda m, k: m.join(k, ["a", "b"], "left_anti"), known, more)
    exact = _stored(new(exact_pairs(docs, only, among), pairs), "pairs")
    finer = _stored(new(candidate_pairs(docs, True, only, among=among), pairs, exact), "pairs")
    more = _stored(_compared(docs, exact.unionByName(finer)), "found")
    return found.unionByName(more).unionByName(copies)


def _cut_batches(batches):
    """Texts without the words of their spans; the last column holds the spans."""
    for batch in batches:
        texts = []
        spans = batch.column(1).to_pylist()
        for a, b, data, offsets in pieces(batch.column(0)):
            found = words(data, offsets)
            for i in range(b - a):
                own = slice(found.row_at[i], found.row_at[i + 1])
                starts = np.append(found.starts[own], offsets[i + 1])
                drop = np.zeros(len(starts), bool)
                for s in spans[a + i]:
                    drop[s["first_word"]:s["end_word"]] = True
                drop[-1:] = False
                row, at = data[offsets[i]:offsets[i + 1]].tobytes(), starts - offsets[i]
                kept = [row[:at[0]]] + [row[s:e] for s, e, d in zip(at[:-1].tolist(), at[1:].tolist(), drop[:-1].tolist()) if not d]
                texts.append(b"".join(kept).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that earlier documents hold; what has no word left goes.

    ``n_chars``, where there, is counted anew for the texts that change. Other columns may have
    any names and are kept as they are.
    """
    found = _stored(repeated_passages(docs), "found")
    spans = found.groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))
    own, text_id, cuts = free(docs, "id", "text_id", "spans")
    spans = spans.select(F.col("doc_id").alias(own), F.col("text_id").alias(text_id), F.col("spans").alias(cuts))
    named = docs.withColumns({text_id: F.xxhash64("text"), own: F.col("doc_id").cast("bigint")})
    joined = named.join(spans, [own, text_id], "left")
    whole = joined.filter(F.col(cuts).isNull()).select(*docs.columns)
    rest = [c for c in docs.columns if c != "text"]
    cut = joined.filter(F.col(cuts).isNotNull()).select("text", cuts, *rest)
    cut = cut.mapInArrow(_cut_batches, docs.select("text", *rest).schema).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.length("text").cast(kind))
    return whole.unionByName(cut.select(*docs.columns))
