"""Near duplicates by SimHash: pigeonhole blocks, then the Hamming distance.

A text is lower-cased (A-Z), split at white space and hashed as runs of three
words (XXH64, seed 42). A fingerprint bit is set if over half of the hashes have
it. Two fingerprints that differ in at most three of 64 bits agree on at least
two of five blocks, so rows joined on two blocks (about 26 bits) hold every close
pair; at 26 bits buckets stay short even for very many texts.

Defined cases: null, empty and blank texts have fingerprint zero, linked like any
other; fewer than three words are one run; equal rows share one fingerprint; null
ids link like others and never become a component id unless all are null. Only
``doc_id`` and ``text`` are read; a very long text is one row of its worker and counts whole. No
rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from detlake.llm.components import components
from detlake.llm.sample import free
from detlake.llm.text import LOWER, SPACE, Words, pieces, words
from detlake.session import materialize

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCKS = 5
TILE = 1000  # fingerprints of one bucket that one group compares; larger buckets are tiled


def _joined(data: np.ndarray, found: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased bytes with one space after each word, and the words' new places."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    moved = np.cumsum(keep) - 1
    text = np.where(space, np.uint8(0x20), LOWER[data])[keep]
    return text.tobytes(), moved[found.starts], moved[found.ends - 1] + 1


def _shingle_hashes(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of words and where each row's runs begin."""
    count = np.diff(found.row_at)
    size = np.minimum(count, SHINGLE)
    n = np.where(count > 0, count - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(found.row_at[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
    last = first + np.repeat(size, n) - 1
    text, starts, ends = _joined(data, found) if len(found) else (b"", found.starts, found.ends)
    digest = xxhash.xxh64_intdigest
    pairs = zip(starts[first].tolist(), ends[last].tolist())
    return np.fromiter((digest(text[s:e], SEED) for s, e in pairs), np.uint64, int(at[-1])), at


def _majority(values: np.ndarray, at: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Per row the 64 bits that over half of its values have."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ones = np.zeros((len(at) - 1, 64), np.int64)
    for i in range(0, len(values), block):
        bits = np.unpackbits(values[i:i + block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = rows[i:i + block]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        ones[own[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    over = 2 * ones > np.diff(at)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view(np.int64).ravel()


def _fingerprint_batches(batches):
    for batch in batches:
        out = [np.zeros(0, np.int64)]
        for _, _, data, offsets in pieces(batch.column(1)):
            out.append(_majority(*_shingle_hashes(data, words(data, offsets))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the fingerprint ``fp`` (64 bits as a signed number) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_fingerprint_batches, f"doc_id {kind}, fp bigint")


def _block_masks(blocks: int, distance: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _close_batches(distance: int):
    """Links between close fingerprints of equal group; rows come sorted by group."""

    def close(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        label, here = np.arange(len(fp)), np.arange(len(fp))
        a, b, step = [fp[:0]], [fp[:0]], 1
        while len(here):
            here = here[here + step < len(fp)]
            here = here[group[here] == group[here + step]]
            near = here[np.bitwise_count(fp[here] ^ fp[here + step]) <= distance]
            near = near[label[near] != label[near + step]]
            if len(near):  # links within what is linked already are left out
                a.append(fp[near])
                b.append(fp[near + step])
                x, y = label[near], label[near + step]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
            step += 1
        columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    def run(batches):
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            group = np.concatenate([group, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(group, group[-1])) if len(group) else 0
            if cut:
                yield close(group[:cut], fp[:cut])
                group, fp = group[cut:], fp[cut:]
        if len(group):
            yield close(group, fp)

    return run


def close_links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links ``(a, b)`` that join all different fingerprints ``fp`` at most ``distance`` apart.

    Every close pair is compared; a link within a group that is linked already is
    left out, so a group of near copies gives links in its size, not its square.
    A bucket above ``TILE`` fingerprints is cut into chunks by hash, and each pair
    of chunks is one group, so no task holds a bucket.
    """
    fp = F.col("fp")
    keys = F.array(*[
        F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m)).alias("key"))
        for t, m in enumerate(_block_masks(blocks, distance))
    ])
    members = materialize(prints.select("fp").distinct(), "simhash-prints").select("fp", F.inline(keys))
    shared = members.groupBy("t", "key").count().filter("count > 1")
    shared = materialize(shared.select("t", "key", F.ceil(F.col("count") / TILE).alias("chunks")), "simhash-blocks")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    tiles = members.join(shared, ["t", "key"]).withColumn("own", own)
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    group = F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other"))
    tiles = tiles.select(group.alias("grp"), "fp").repartition("grp").sortWithinPartitions("grp")
    return tiles.mapInArrow(_close_batches(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``, one row per row of ``docs``."""
    prints = materialize(fingerprints(docs), "simhash-docs")
    roots = components(close_links(prints), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = F.coalesce("root", "fp").alias("root")
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", root)
    classes = materialize(classes, "simhash-classes")
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = materialize(classes.join(materialize(ids, "simhash-ids"), "root").select("fp", "component_id"), "simhash-ids")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(classes, "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each group, the smallest id.

    Rows that share id and text are one row afterwards; rows that share an id alone are
    documents of their own. Where all ids of a group are null, the row with the least text
    hash stays. Other columns may have any names and are kept as they are.
    """
    (name,) = free(docs, "key")
    own = F.coalesce(F.concat(F.lit("id "), F.col("doc_id").cast("string")), F.lit("none"))
    named = docs.withColumn(name, F.concat_ws("/", own, F.xxhash64("text").cast("string")))
    found = near_duplicates(named.select(F.struct("doc_id", F.col(name).alias("key")).alias("doc_id"), "text"))
    doc_id, key = F.col("doc_id.doc_id"), F.col("doc_id.key")
    order = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), key.alias("key"))
    first = found.groupBy("component_id").agg(F.min(order).alias("first")).select("first.key")
    rows = found.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
    chosen = materialize(first.distinct().join(rows, "key"), "simhash-kept").withColumnRenamed("key", name)
    once = named.join(chosen.filter("n = 1").select(name), name, "left_semi")
    more = named.join(chosen.filter("n > 1").select(name), name, "left_semi").dropDuplicates([name])
    return once.unionByName(more).select(*docs.columns)
