"""Frequent phrases of each language, counted inside the chunks of a prefix-free parse.

A text is cut where the hash of two words in a row is zero modulo ``MODULUS``: a chunk goes
from one such trigger to ``OVERLAP`` words past the next, so equal passages are cut
alike wherever they stand. Distinct chunks with the number of times they are parsed
are the dictionary (a stored table); from there on a passage or copy
counts once with its frequency as weight. An n-gram belongs to the chunk in whose
body (the part before the overlap) it begins, so overlaps are assigned once.

Counts go up by length: an n-gram is counted only where both its parts of one word
less are frequent, as told by a broadcast bitmap of hashed n-grams of ``BITS`` bits (false
hits cost time, never a result). A last pass counts the phrases that
are left by their words, so hashes decide nothing but what is looked at.

Words are split at space and tab, pieces at ``. , ; : ! ?`` and the characters 0x0A-0x0D;
A-Z are lower-cased. Defined cases: null and empty texts have no words; null lang
is ``und``, with texts that say so; repeated rows count each time; equal scores go by count, then
phrase in byte order; a chunk without a trigger ends after ``LONGEST`` words, so
a very long text is many chunks; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake.llm.text import LOWER, add_by_row, hashes, mix, pieces, words
from detlake.session import materialize

LONGEST_PHRASE = 4
OVERLAP = LONGEST_PHRASE - 1
LEAST = 30
COVER = 80  # in 100 occurrences of a phrase inside a longer one
TOP = 2000
MODULUS = 32
LONGEST = 4096
BITS = 1 << 26  # 8 MB
HELD = 1 << 21  # n-grams a task holds before it sends them on
SALTS = 64
UNKNOWN = "und"

_BREAK = np.isin(np.arange(256), list(b".,;:!?\x0a\x0b\x0c\x0d"))
_SEPARATOR = _BREAK | np.isin(np.arange(256), [0x20, 0x09])


def _pieces_of(data: np.ndarray, offsets: np.ndarray):
    """Words, their hashes, and which begin a piece."""
    found = words(data, offsets, _SEPARATOR)
    breaks = np.concatenate([[0], np.cumsum(_BREAK[data])])
    new = np.ones(len(found), bool)
    new[1:] = breaks[found.starts[1:]] > breaks[found.ends[:-1]]
    new[found.row_at[:-1][np.diff(found.row_at) > 0]] = True
    return found, hashes(data, found, LOWER), new


def _cuts(h: np.ndarray, new: np.ndarray, row_at: np.ndarray) -> np.ndarray:
    """Where chunks begin: rows, triggers, and every ``LONGEST`` words without one."""
    trigger = np.zeros(len(h), bool)
    trigger[:-1] = mix(h[:-1] * np.uint64(3) + h[1:] + new[1:].astype(np.uint64)) % np.uint64(MODULUS) == 0
    first, last = row_at[:-1], row_at[1:] - 1
    some = last >= first
    trigger[last[some]] = False
    trigger[first[some]] = True
    at = np.append(np.flatnonzero(trigger), len(h))
    more = np.maximum(np.diff(at) - 1, 0) // LONGEST + 1
    begin = np.cumsum(more) - more
    return np.repeat(at[:-1], more) + (np.arange(more.sum()) - np.repeat(begin, more)) * LONGEST


def _normal(data: np.ndarray, found, new: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Lower-cased words with one blank, or one line end between pieces, and where each begins and ends."""
    size = found.ends - found.starts
    starts = np.cumsum(size + 1) - size - 1
    from_ = np.repeat(found.starts - starts, size + 1) + np.arange(int((size + 1).sum()))
    out = LOWER[data[from_.clip(max=max(len(data) - 1, 0))]]
    ends = starts + size
    out[ends[:-1]] = np.where(new[1:], 0x0A, 0x20)
    return out.tobytes(), starts, ends


def _parse(batches):
    for batch in batches:
        for a, b, data, offsets in pieces(batch.column(1)):
            found, h, new = _pieces_of(data, offsets)
            if not len(found):
                continue
            at = _cuts(h, new, found.row_at)
            row = np.searchsorted(found.row_at, at, "right") - 1
            stop = np.minimum(np.append(at[1:], len(h)), found.row_at[row + 1])
            end = np.minimum(stop + OVERLAP, found.row_at[row + 1])
            text, starts, ends = _normal(data, found, new)
            langs = batch.column(0).slice(a, b - a).to_pylist()
            spans = zip(row.tolist(), (stop - at).tolist(), starts[at].tolist(), ends[end - 1].tolist())
            seen = Counter((langs[r], body, text[s:e]) for r, body, s, e in spans)
            lang, body, chunk = zip(*seen)
            yield pa.RecordBatch.from_arrays([
                pa.array(lang, pa.string()), pa.array(body, pa.int32()), pa.array(chunk, pa.binary()).cast(pa.string()),
                pa.array(seen.values(), pa.int64())], ["lang", "body", "chunk", "times"])


def dictionary(docs: DataFrame) -> DataFrame:
    """Distinct chunks of each language: ``lang``, ``body`` (words before the overlap), ``chunk``, ``times``."""
    rows = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    found = rows.mapInArrow(_parse, "lang string, body int, chunk string, times bigint")
    return found.groupBy("lang", "body", "chunk").agg(F.sum("times").alias("times"))


def _seed(langs: list[str]) -> np.ndarray:
    own = {lang: i for i, lang in enumerate(dict.fromkeys(langs))}
    data, at = np.frombuffer("".join(own).encode(), np.uint8), np.cumsum([0, *(len(k.encode()) for k in own)])
    sums = np.zeros(len(own), np.uint64)
    rows = np.repeat(np.arange(len(own)), np.diff(at))
    add_by_row(sums, rows, mix(data.astype(np.uint64) + np.uint64(257) * (np.arange(len(data)) - at[:-1][rows]).astype(np.uint64)))
    return mix(sums)[[own[lang] for lang in langs]] if langs else sums


def _grams(batch: pa.RecordBatch, known):
    """N-grams of a batch of chunks by length: hash, whether it is to be looked at, and all of their words.

    ``known[k]`` are the frequent ones of ``k + 1`` words.
    """
    times = batch.column(3).to_numpy()
    seeds, bodies = _seed(batch.column(0).to_pylist()), batch.column(1).to_numpy()
    for a, b, data, offsets in pieces(batch.column(2)):
        found, h, new = _pieces_of(data, offsets)
        row = found.rows()
        at = np.flatnonzero(new)
        left = np.repeat(np.append(at[1:], len(h)), np.diff(np.append(at, len(h)))) - np.arange(len(h))
        own = np.arange(len(h)) - found.row_at[:-1][row] < bodies[a:b][row]  # begins in the body
        h = mix(h + seeds[a:b][row])
        g, ok, out = h, np.ones(len(h), bool), []
        for k in range(len(known) + 1):
            if k:
                may = _held(known[k - 1], g) & ok
                g = mix(g[:-1] * np.uint64(3) + h[k:] + np.uint64(k))
                ok = may[:-1] & may[1:] & (left[:len(g)] > k)
            out.append((g, ok & own[:len(g)]))
        yield data, found, row, times[a:b], batch.column(0).slice(a, b - a), out


def _place(key: np.ndarray) -> np.ndarray:
    return (key % np.uint64(BITS)).astype(np.int64)


def _held(bits, key: np.ndarray) -> np.ndarray:
    at = _place(key)
    return bits.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 == 1


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(key, return_inverse=True)
    out = np.zeros(len(own), np.int64)
    np.add.at(out, at, count)
    return own, out


def _counts(known):
    def run(batches):
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def send():
            key, count = _summed(np.concatenate(keys), np.concatenate(counts))
            keys[:], counts[:] = [key], [count]
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "count"])

        for batch in batches:
            for _, _, row, times, _, grams in _grams(batch, known):
                g, on = grams[-1]
                key, count = _summed(g[on], times[row[:len(g)][on]])
                keys.append(key)
                counts.append(count)
            if sum(map(len, keys)) > HELD:
                out = send()
                if len(out) > HELD // 2:
                    yield out
                    keys[:], counts[:] = [keys[0][:0]], [counts[0][:0]]
        yield send()

    return run


def _frequent(chunks: DataFrame, known: list) -> object:
    """Broadcast bitmap of the hashes of n-grams that may occur ``LEAST`` times."""
    found = chunks.mapInArrow(_counts(known), "key bigint, count bigint").groupBy("key").agg(F.sum("count").alias("count"))
    place = found.filter(F.col("count") >= LEAST).select(F.expr(f"key & {BITS - 1}").alias("p"))
    rows = place.groupBy(F.expr("p div 32768").alias("part")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("m"))
    out = np.zeros(BITS, bool)
    for r in rows.collect():  # BITS / 8 bytes at most
        bits = np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")
        out[r["part"] * 32768:(r["part"] + 1) * 32768] = bits
    return chunks.sparkSession.sparkContext.broadcast(np.packbits(out))


def _phrases(known):
    def run(batches):
        for batch in batches:
            for data, found, row, times, langs, grams in _grams(batch, known[:-1]):
                text, starts, ends = _normal(data, found, np.zeros(len(found), bool))
                for k, (g, on) in enumerate(grams):
                    at = np.flatnonzero(on & _held(known[k], g))
                    _, first, own = np.unique(g[at], return_index=True, return_inverse=True)
                    count = np.zeros(len(first), np.int64)
                    np.add.at(count, own, times[row[at]])
                    at = at[first]
                    spans = zip(starts[at].tolist(), ends[at + k].tolist())
                    yield pa.RecordBatch.from_arrays([
                        langs.take(pa.array(row[at])), pa.array([text[s:e] for s, e in spans], pa.binary()).cast(pa.string()),
                        pa.array(np.full(len(at), k + 1, np.int32)), pa.array(count)], ["lang", "phrase", "size", "a"])

    return run


def phrases(chunks: DataFrame) -> DataFrame:
    """Words and phrases of up to ``LONGEST_PHRASE`` words with ``LEAST`` occurrences: ``lang``, ``phrase``, ``size``, ``a``."""
    known: list = []
    for _ in range(LONGEST_PHRASE):
        known.append(_frequent(chunks, known))
    found = chunks.mapInArrow(_phrases(known), "lang string, phrase string, size int, a bigint")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).filter(F.col("a") >= LEAST)


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Phrases that no longer one covers, with the counts of their lowest-scoring cut: ``lang, phrase, a, l, r, score``."""
    found = counts.filter("size > 1").withColumn("words", F.split("phrase", " "))
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"),
                     _part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    known = counts.select("lang", "phrase", "a")
    cut = cut.join(known.toDF("lang", "left", "l"), ["lang", "left"]).join(known.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(38,0)) * a div (l + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    cut = cut.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inside = found.filter("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inside = inside.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    inside = inside.select("lang", _part(F.col("i"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase")
    cut = cut.join(inside.agg(F.max("a").alias("longer")), ["lang", "phrase"], "left")
    covered = F.coalesce(_wide(F.col("longer")) * 100 >= _wide(F.col("a")) * COVER, F.lit(False))
    return cut.filter(~covered).drop("longer")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: the ``top`` phrases of each language."""
    chunks = materialize(dictionary(docs), "phrases-chunks")
    counts = materialize(phrases(chunks), "phrases-counts")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    salted = scored(counts).withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")  # top x SALTS rows at most
    ranked = some.withColumn("rank", best).filter(F.col("rank") <= top)
    n = chunks.groupBy("lang").agg(F.sum(F.col("times") * F.col("body")).alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with parts as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as part from documents),
lists as (select lang, regexp_extract_all(part, '[^\x20\x09]+') as w from parts),
total as (select lang, sum(len(w))::bigint as n from lists group by lang),
grams as (
  select lang, k::int as size, array_to_string(w[i:i + k - 1], ' ') as phrase
  from lists, (values (1), (2), (3), (4)) sizes(k), unnest(range(1, len(w) - k + 2)) starts(i)),
counts as (select lang, size, phrase, count(*) as a from grams group by all having count(*) >= 30),
cuts as (
  select c.lang, c.phrase, c.a, c.size, k, l.a as l, r.a as r, (2000000::hugeint * c.a) // (l.a + r.a) as score
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, size)) as k from counts where size > 1) c
  join counts l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.k], ' ')
  join counts r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
longer as (
  select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(a) as longer
  from (select *, string_split(phrase, ' ') as w from counts where size > 2), (values (2), (3)) sizes(k), unnest(range(1, size - k + 2)) starts(i)
  where k < size group by all),
kept as (
  select lang, phrase, a, l, r, score::bigint as score from lowest left join longer using (lang, phrase)
  where longer is null or 100::hugeint * longer < 80::hugeint * a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join total using (lang) qualify rank <= 2000
"""
