"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per source, language and topic. Raking finds one factor per
source, per language and per topic so that the factored token counts meet the
target shares of all three at once. A document's factor product, scaled so that
the largest is a probability of one, is the chance with which it is sampled; the
draw is a hash of the document, so it can be repeated.

The counts are one row per source with a small matrix of languages by topics. In
each round a source's factor follows from its own row; what goes to the driver are
the languages by topics sums of all sources, so any number of sources will do.
Languages and topics are closed sets (``MAX_LANGS``, ``topics``).

Target shares may be given per value; values left out, and all by default, aim at
their share to the power ``TEMPERATURE``, which lifts small ones. A document's topic
is the word group that is most over-represented in it: words of four letters or more
fall into ``topics`` groups by hash, and group counts are compared with the shares of
all documents.

Defined cases: null source or language is a value of its own; texts without words
have no tokens, no topic words (topic 0) and the factors of their cell; repeated
rows are drawn alike; no rows give no rows; a target of zero drops its value; of topics that are
over-represented alike the first counts; very long texts are worked on whole; targets that
cannot be met together (a language that one source alone has, say) are met as nearly as
``ROUNDS`` rounds bring them, with a warning and the gap as column ``off``; more than ``MAX_LANGS``
languages raise ``ValueError``.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from detlake.llm.sample import free
from detlake.llm.text import NOT_ALNUM, SPACE, add_by_row, hashes, pieces, words
from detlake.session import materialize

TOPICS = 8
TEMPERATURE = 0.7
ROUNDS = 100
CLOSE = 1e-6
APART = 1e-3  # shares further off than this after all rounds are warned of
MAX_LANGS = 1024
SEED = 17


def _count_batches(topics: int):
    def run(batches):
        for batch in batches:
            n, groups = [np.zeros(0, np.int64)], [np.zeros((0, topics), np.int64)]
            for a, b, data, offsets in pieces(batch.column(batch.num_columns - 1)):
                n.append(np.diff(words(data, offsets, SPACE).row_at))
                found = words(data, offsets, NOT_ALNUM)
                long = found.ends - found.starts >= 4
                group = (hashes(data, found)[long] >> np.uint64(32)) % np.uint64(topics)
                row = found.rows()[long]
                flat = np.bincount(row * topics + group.astype(np.int64), minlength=(b - a) * topics)
                groups.append(flat.reshape(-1, topics))
            flat = np.concatenate(groups)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * topics), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.concatenate(n)), lists], [*batch.schema.names[:-1], "n_tokens", "groups"])

    return run


def _named(c: str):
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def profile(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``draw`` (0 to 1), ``text_id``, ``n_tokens`` and ``topic`` of every row."""
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(1 << 40)) / float(1 << 40)
    rows = docs.select("doc_id", "source", "lang", draw.alias("draw"), F.xxhash64("text").alias("text_id"), F.lower("text").alias("text"))
    schema = rows.drop("text").schema.add("n_tokens", LongType()).add("groups", ArrayType(LongType()))
    counts = materialize(rows.mapInArrow(_count_batches(topics), schema), "mixing-counts")
    sums = counts.agg(*[F.sum(F.col("groups")[k]).alias(str(k)) for k in range(topics)]).first()
    total = [max(float(s or 0), 1.0) for s in sums]
    over = F.array(*[F.col("groups")[k] / F.lit(total[k]) for k in range(topics)])
    topic = (F.array_position(over, F.array_max(over)) - 1).cast("int")
    return counts.select("doc_id", "source", "lang", "draw", "text_id", "n_tokens", topic.alias("topic"))


def _targets(tokens: np.ndarray, names: list, given: dict | None) -> np.ndarray:
    """Shares to aim at: the given ones, the rest by their tokens to the power ``TEMPERATURE``."""
    soft = np.where(tokens > 0, np.maximum(tokens, 1.0) ** TEMPERATURE, 0.0)
    if not given:
        return soft / max(soft.sum(), 1e-300)
    fixed = np.array([given.get(n, np.nan) for n in names], float)
    free = np.isnan(fixed)
    rest = max(0.0, 1 - np.nansum(fixed))
    out = np.where(free, rest * soft / max(soft[free].sum(), 1e-300), fixed)
    return np.where(tokens > 0, out, 0) / max(np.where(tokens > 0, out, 0).sum(), 1e-300)


def factors(rows: DataFrame, langs_to: dict | None = None, topics_to: dict | None = None,
            sources_to: dict | None = None, topics: int = TOPICS) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray, float]:
    """Raked factors: a table ``(_source, a)`` per source, the languages, factors per language and topic, and how far off shares are.

    ``*_to`` map values (null as None) to target shares of all tokens.
    """
    cells = rows.filter("n_tokens > 0").groupBy(_named("source").alias("_source"), _named("lang").alias("_lang"), "topic")
    cells = materialize(cells.agg(F.sum("n_tokens").alias("n")), "mixing-cells")
    by_lang = cells.groupBy("_lang").agg(F.sum("n").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(by_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    by_lang = sorted(by_lang, key=lambda r: r["_lang"])
    langs = [r["_lang"] for r in by_lang]
    by_topic = np.zeros(topics)
    for r in cells.groupBy("topic").agg(F.sum("n").alias("n")).collect():
        by_topic[r["topic"]] = r["n"]
    key = lambda d: {("" if k is None else f"={k}"): v for k, v in d.items()} if d else None
    to_lang = _targets(np.array([r["n"] for r in by_lang], float), langs, key(langs_to))
    to_topic = _targets(by_topic, list(range(topics)), topics_to)
    place = F.array_position(F.array(*map(F.lit, langs)), F.col("_lang")) - 1 if langs else F.lit(0)
    cell = F.struct((place * topics + F.col("topic")).alias("at"), F.col("n").cast("double").alias("n"))
    table = cells.groupBy("_source").agg(F.collect_list(cell).alias("cells"), F.sum("n").cast("double").alias("n"))
    goal = key(sources_to) or {}
    soft = F.pow("n", F.lit(TEMPERATURE))
    if goal:
        named = rows.sparkSession.createDataFrame([(k, float(v)) for k, v in goal.items()], "_source string, want double")
        table = table.join(named, "_source", "left")
        free = F.col("want").isNull()
        left = table.agg(F.sum("want").alias("w"), F.sum(F.when(free, soft)).alias("s")).first()
        rest = max(0.0, 1 - (left["w"] or 0.0)) / max(left["s"] or 0.0, 1e-300)
        table = table.withColumn("goal", F.coalesce("want", soft * rest))
    else:
        table = table.withColumn("goal", soft / F.lit(table.agg(F.sum(soft).alias("s")).first()["s"] or 1.0))
    table = materialize(table.select("_source", "cells", "goal"), "mixing-table")
    b, c, off = np.ones(len(langs)), np.ones(topics), 0.0

    def weighted(bc: np.ndarray):
        lit = F.array(*[F.lit(float(x)) for x in bc])
        own = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["n"] * F.get(lit, x["at"].cast("int")))
        return F.when(own > 0, F.col("goal") / own).otherwise(0.0)

    for _ in range(ROUNDS if langs else 0):
        scaled = table.select(weighted(np.outer(b, c).ravel()).alias("a"), F.inline("cells")).groupBy("at")
        sums = np.zeros(len(langs) * topics)
        for r in scaled.agg(F.sum(F.col("a") * F.col("n")).alias("m")).collect():
            sums[r["at"]] = r["m"]
        m = sums.reshape(len(langs), topics)
        off = np.abs((m * np.outer(b, c)).sum(1) - to_lang).max() + np.abs((m * np.outer(b, c)).sum(0) - to_topic).max()
        if off < CLOSE:
            break
        for _ in range(5):
            b = to_lang / np.maximum(m @ c, 1e-300)
            c = to_topic / np.maximum(m.T @ b, 1e-300)
    if off > APART:
        warnings.warn(f"no factors meet the targets: after {ROUNDS} rounds shares are {off:.3g} off")
    return table.select("_source", weighted(np.outer(b, c).ravel()).alias("a")), langs, b, c, float(off)


def mix_sources(docs: DataFrame, langs_to: dict | None = None, topics_to: dict | None = None,
                sources_to: dict | None = None, topics: int = TOPICS) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``topic``, ``n_tokens``, ``prob``, ``draw``, ``text_id``, ``off`` and ``kept`` of every row."""
    rows = profile(docs, topics)
    by_source, langs, b, c, off = factors(rows, langs_to, topics_to, sources_to, topics)
    by_source = materialize(by_source, "mixing-factors")
    lang_at = F.array_position(F.array(*map(F.lit, langs)), _named("lang")) if langs else F.lit(0)
    lang_factor = F.get(F.array(F.lit(0.0), *[F.lit(float(x)) for x in b]), lang_at.cast("int"))
    topic_factor = F.get(F.array(*[F.lit(float(x)) for x in c]), F.col("topic"))
    out = rows.withColumn("_source", _named("source")).join(by_source, "_source", "left")
    out = out.withColumn("_w", F.coalesce(F.col("a") * lang_factor * topic_factor, F.lit(0.0)))
    out = materialize(out.drop("_source", "a"), "mixing-weights")
    most = out.filter("n_tokens > 0").agg(F.max("_w").alias("w")).first()["w"] or 1.0
    prob = F.least(F.col("_w") / F.lit(float(most)), F.lit(1.0))
    return out.select("doc_id", "source", "lang", "topic", "n_tokens", prob.alias("prob"), "draw", "text_id",
                      F.lit(off).alias("off"), (F.col("draw") < prob).alias("kept"))


def sample(docs: DataFrame, **targets) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their ``topic`` and ``prob``.

    Columns of ``docs`` stay as they are: where one is named ``topic`` or ``prob``, the new
    column has an underscore behind its name.
    """
    drawn = mix_sources(docs, **targets).filter("kept")
    topic, prob = free(docs, "topic", "prob")
    keys = free(docs, "id", "text_id", "source_name", "lang_name")
    named = [_named("doc_id"), None, _named("source"), _named("lang")]
    drawn = drawn.select(
        *[(F.col("text_id") if c is None else c).alias(k) for k, c in zip(keys, named)], F.col("topic").alias(topic), F.col("prob").alias(prob))
    rows = docs.withColumns({k: F.xxhash64("text") if c is None else c for k, c in zip(keys, named)})
    return rows.join(drawn.dropDuplicates(keys), keys).select(*docs.columns, topic, prob)
