"""Ranked lexical search: posting lists cut into blocks of alike documents, skipped by exact bounds.

A document is a sparse vector of term impacts. Documents are sorted by a code of 32
signs of random projections of their weighted vectors, so that neighbours are alike,
and dealt into chunks. Within a chunk the posting list of every asked term is cut into blocks
of ``BLOCK`` documents in that order, and each block keeps, coordinate by
coordinate, the greatest impact of any of its documents (rounded up to 8 bits, so it
stays a bound). The index is a stored table of chunks. For an item, terms that
even together stay below the score to beat are left aside (a document that holds no
other term cannot win); of the others' lists a block is skipped only if the item's
product with its summary is below that score, and the documents of what is left
are scored exactly. The score to beat is the ``top``-th best seen so far by the task;
equal scores are never skipped.

Items are asked in blocks of at most ``ITEMS`` items and ``TERMS`` terms (one item, if it has
more); each block indexes all documents under the terms it asks for. Only the block's terms and
one number per term are broadcast or pass through the driver.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z
lower-cased. Defined cases: null, empty or term-less texts are no documents and no
counts; items without a known term have no rows; rows that share an ``item_id`` are one
item with the terms of all, null ids included; rows that share a ``doc_id`` are each
ranked; null ids come last among ties; very long texts are worked on whole, a piece
of rows at a time; other columns are not read. No documents or items give no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from detlake.llm.text import LOWER, NOT_ALNUM, add_by_row, hashes, mix, pieces, words
from detlake.session import materialize

TOP = 50
BLOCK = 64
CHUNK = 2048  # documents; fewer where their terms are many
CELLS = 1 << 23  # documents x terms of a chunk
ITEMS = 5000
TERMS = 1 << 20
NEAR = 1 << 24
STEP = 4000  # impacts are below 10**6, so a summary in steps of 4000 takes 8 bits


def _terms(column: pa.Array):
    """Pieces of a text column: first and end row, the hash of every term, and where rows begin."""
    for a, b, data, offsets in pieces(column):
        found = words(data, offsets, NOT_ALNUM)
        yield a, b, hashes(data, found, LOWER), found.row_at


def _item_batches(batches):
    for batch in batches:
        out = [b""] * len(batch)
        for a, b, values, at in _terms(batch.column(1)):
            out[a:b] = [np.unique(values[at[i]:at[i + 1]]).tobytes() for i in range(b - a)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["item_id", "terms"])


def _item_blocks(items: DataFrame):
    """Blocks of items: their ids and the hashes of their terms."""
    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(_item_batches, f"item_id {kind}, terms binary")
    found = materialize(found.groupBy("item_id").agg(F.collect_set("terms").alias("terms")), "lexical-items")
    ids, terms, many = [], [], 0
    for row in found.orderBy("item_id").toLocalIterator():
        own = np.unique(np.frombuffer(b"".join(row["terms"]), np.uint64))
        if ids and (len(ids) >= ITEMS or many + len(own) > TERMS):
            yield ids, terms
            ids, terms, many = [], [], 0
        ids.append(row["item_id"])
        terms.append(own)
        many += len(own)
    if ids:
        yield ids, terms


def _counted(vocabulary):
    """Per document with a term: number of terms, and places and counts of those asked for."""

    def run(batches):
        asked = vocabulary.value
        for batch in batches:
            for a, b, values, at in _terms(batch.column(1)):
                place = np.searchsorted(asked, values).clip(max=len(asked) - 1)
                hit = asked[place] == values
                row = np.repeat(np.arange(b - a), np.diff(at))[hit]
                key, tf = np.unique(row * len(asked) + place[hit], return_counts=True)
                cut = np.searchsorted(key // len(asked), np.arange(b - a + 1))
                term, tf = (key % len(asked)).astype(np.int32), tf.astype(np.int64)
                some = np.flatnonzero(np.diff(at) > 0).tolist()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(some, pa.int64())), pa.array(np.diff(at)[some].astype(np.int64)),
                    pa.array([term[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary()),
                    pa.array([tf[cut[i]:cut[i + 1]].tobytes() for i in some], pa.binary())], ["doc_id", "n", "term", "tf"])

    return run


def _joined(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of byte strings one after the other, and how many each row has."""
    parts = [np.frombuffer(v.as_buffer(), kind) for v in column]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def _term_counts(terms: int):
    def run(batches):
        total = np.zeros(terms, np.int64)
        for batch in batches:
            total += np.bincount(_joined(batch.column(0), np.int32)[0], minlength=terms)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["term", "df"])

    return run


def weight(n: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n`` documents hold."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _impacts(vocabulary, weights, n: int, total: int):
    """Impacts of a document's terms, and the code of signs it is sorted by."""

    def run(batches):
        bits = np.unpackbits(mix(vocabulary.value).view(np.uint8).reshape(-1, 8)[:, :4], axis=1).astype(np.int8) * 2 - 1
        for batch in batches:
            term, size = _joined(batch.column(2), np.int32)
            tf, _ = _joined(batch.column(3), np.int64)
            m = np.array([50 + 50 * x * n // total for x in batch.column(1).to_pylist()], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[row])
            at = np.concatenate([[0], np.cumsum(size)])
            signs = np.zeros((len(size), 32))
            for i in range(0, len(term), 1 << 16):
                own = slice(i, i + (1 << 16))
                add_by_row(signs, row[own], bits[term[own]] * (weights.value[term[own]] * impact[own] / 1e6)[:, None])
            code = np.packbits(signs > 0, axis=1).view(">u4").ravel().astype(np.int64)
            impact = impact.astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(code), batch.column(2),
                pa.array([impact[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())],
                ["doc_id", "code", "term", "impact"])

    return run


_BINARY = ["rows", "term", "impact", "block_term", "block_size", "block_docs", "summary"]


def _dense(rows: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The terms a chunk holds, and its documents' impacts under them."""
    own, at = np.unique(term, return_inverse=True)
    out = np.zeros((docs, len(own)), np.int32)
    out[rows, at] = impact
    return own, out


def _chunk(ids: pa.Array, term: np.ndarray, impact: np.ndarray, size: np.ndarray, near) -> pa.RecordBatch:
    """One chunk: its vectors, the blocks of every term's list and their summaries over the terms asked for with it."""
    rows = np.repeat(np.arange(len(size), dtype=np.int32), size)
    own, dense = _dense(rows, term, impact, len(size))
    steps = (-(-dense // STEP)).astype(np.uint8)
    order = np.argsort(term, kind="stable")
    at = np.searchsorted(term[order], own)
    ends, docs = np.append(at[1:], len(term)), rows[order]
    terms, sizes, summaries = [], [], []
    for t, a, b in zip(own.tolist(), at.tolist(), ends.tolist()):
        cut = np.arange(0, b - a, BLOCK)
        columns = np.searchsorted(own, near(t))
        known = own[columns.clip(max=len(own) - 1)] == near(t)
        top = np.zeros((len(cut), len(known)), np.uint8)
        top[:, known] = np.maximum.reduceat(steps[docs[a:b][:, None], columns[known][None, :]], cut, axis=0)
        terms.append(np.full(len(cut), t, np.int32))
        sizes.append(np.diff(np.append(cut, b - a)).astype(np.int32))
        summaries.append(top.ravel())
    stored = [rows, term, impact, *(np.concatenate(c) for c in (terms, sizes)), docs, np.concatenate(summaries)]
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays([lists, *(pa.array([s.tobytes()], pa.binary()) for s in stored)], ["doc_ids", *_BINARY])


def _chunks(asked):
    def run(batches):
        near = asked.value.near
        for batch in batches:
            first = 0
            while first < len(batch):
                n = min(CHUNK, len(batch) - first)
                while True:  # fewer documents until they fit
                    part = batch.slice(first, n)
                    term, size = _joined(part.column(2), np.int32)
                    if n == 1 or n * len(np.unique(term)) <= CELLS:
                        break
                    n = (n + 1) // 2
                yield _chunk(part.column(0), term, _joined(part.column(3), np.int32)[0], size, near)
                first += n

    return run


class Asked:
    """Items as places in a sorted vocabulary, and for each term those it is asked for with."""

    def __init__(self, terms: list[np.ndarray], vocabulary: np.ndarray):
        self.items = [np.searchsorted(vocabulary, t).astype(np.int32) for t in terms]
        self._all = np.arange(len(vocabulary), dtype=np.int32)
        self._near = None
        if sum(len(t) ** 2 for t in terms) <= NEAR:
            with_it: list[list[np.ndarray]] = [[] for _ in vocabulary]
            for item in self.items:
                for t in item.tolist():
                    with_it[t].append(item)
            self._near = [np.unique(np.concatenate(w)) for w in with_it]

    def near(self, term: int) -> np.ndarray:
        return self._all if self._near is None else self._near[term]


class _Best:
    """The best documents of each item so far: score and id."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1

    def add(self, scores: list[int], ids: list) -> None:
        self.rows += [(s, i) for s, i in zip(scores, ids) if s >= self.least]
        if len(self.rows) > self.top:
            self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
            del self.rows[self.top:]
        if len(self.rows) == self.top:
            self.least = max(1, min(s for s, _ in self.rows))


def _search_chunk(best: list[_Best], asked: Asked, weights: np.ndarray, ids: pa.Array, stored: dict) -> int:
    """Bring the best up to date with one chunk; the number of documents scored."""
    own, dense = _dense(stored["rows"], stored["term"], stored["impact"], len(ids))
    peak = dense.max(axis=0, initial=0).astype(np.int64) * weights[own]
    block_at = np.searchsorted(stored["block_term"], np.arange(len(weights) + 1))
    doc_at = np.concatenate([[0], np.cumsum(stored["block_size"])])
    width = np.array([len(asked.near(t)) for t in stored["block_term"].tolist()], np.int64)
    sum_at = np.concatenate([[0], np.cumsum(width)])
    scored = 0
    for item, state in zip(asked.items, best):
        column = np.searchsorted(own, item).clip(max=max(len(own) - 1, 0))
        held = own[column] == item if len(own) else np.zeros(len(item), bool)
        terms, column = item[held], column[held]
        order = np.argsort(peak[column])
        aside = np.cumsum(peak[column][order]) < state.least
        found = np.zeros(len(ids), bool)
        for t in terms[order[~aside]].tolist():
            a, b = block_at[t], block_at[t + 1]
            near = asked.near(t)
            tops = stored["summary"][sum_at[a]:sum_at[b]].reshape(b - a, len(near))
            bound = tops[:, np.searchsorted(near, item)].astype(np.int64) @ weights[item] * STEP
            for k in (np.flatnonzero(bound >= state.least) + a).tolist():
                found[stored["block_docs"][doc_at[k]:doc_at[k + 1]]] = True
        on = np.flatnonzero(found)
        scored += len(on)
        if len(on):
            scores = dense[on[:, None], column[None, :]].astype(np.int64) @ weights[terms]
            good = np.flatnonzero(scores >= state.least)
            if len(good) > state.top:  # all that reach the top-th score
                good = good[scores[good] >= np.partition(scores[good], -state.top)[-state.top]]
            state.add(scores[good].tolist(), ids.take(pa.array(on[good])).to_pylist())
    return scored


def _searched(asked, weights, top: int, kind: pa.DataType):
    def run(batches):
        best = [_Best(top) for _ in asked.value.items]
        for batch in batches:
            for i in range(len(batch)):
                kinds = dict.fromkeys(_BINARY, np.int32) | {"summary": np.uint8}
                stored = {c: np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in kinds.items()}
                _search_chunk(best, asked.value, weights.value, batch.column("doc_ids")[i].values, stored)
        rows = [(i, s, d) for i, b in enumerate(best) for s, d in b.rows]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], kind)], ["item", "score", "doc_id"])

    return run


def index(docs: DataFrame, terms: list[np.ndarray]) -> tuple[DataFrame, object, object]:
    """The stored index of all ``docs`` under the terms of some items, with the items and weights as broadcasts."""
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = np.unique(np.concatenate(terms))
    words_asked = sc.broadcast(vocabulary)
    counted = docs.select("doc_id", "text").mapInArrow(_counted(words_asked), f"doc_id {kind}, n bigint, term binary, tf binary")
    counted = materialize(counted, "lexical-counts")
    n, total = counted.agg(F.count("*"), F.sum("n")).first()
    df = counted.select("term").mapInArrow(_term_counts(len(vocabulary)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in df.collect():  # at most TERMS rows, or those of one item
        weights[row["term"]] = weight(n, row["df"])
    weights, asked = sc.broadcast(weights), sc.broadcast(Asked(terms, vocabulary))
    vectors = counted.filter(F.length("term") > 0)
    vectors = vectors.mapInArrow(_impacts(words_asked, weights, n, total or 1), f"doc_id {kind}, code bigint, term binary, impact binary")
    vectors = vectors.withColumn("tie", F.xxhash64("doc_id"))
    vectors = vectors.repartitionByRange("code", "tie").sortWithinPartitions("code", "tie").drop("tie")
    schema = f"doc_ids array<{kind}>, " + ", ".join(f"{c} binary" for c in _BINARY)
    return materialize(vectors.mapInArrow(_chunks(asked), schema), "lexical-index"), asked, weights


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score``: the ``top`` best documents of each item."""
    spark = docs.sparkSession
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (items, "item_id")))
    arrow = spark.createDataFrame([], f"doc_id {kind}").toArrow().schema.field(0).type
    out = []
    for ids, terms in _item_blocks(items):
        if not sum(len(t) for t in terms):
            continue
        stored, asked, weights = index(docs, terms)
        found = stored.mapInArrow(_searched(asked, weights, top, arrow), f"item bigint, score bigint, doc_id {kind}")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = materialize(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top), "lexical-found")
        names = spark.createDataFrame(list(enumerate(ids)), f"item bigint, item_id {item_kind}")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    empty = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    return functools.reduce(DataFrame.unionByName, out) if out else empty


ORACLE = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
counts as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from counts group by doc_id),
corpus as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
held as (select term, count(*) as df from counts group by term),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
scored as (
  select item_id, doc_id,
    sum(floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint
      * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))))::bigint as score
  from asked join held using (term) join counts using (term) join sizes using (doc_id), corpus group by item_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 50
"""
