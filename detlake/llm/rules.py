"""Quality rules whose cuts come from the data, per language and source.

Per text the rules look at four numbers: mean word length, symbols among the word
characters, repeated lines and words in repeated three-word windows. Each becomes
a whole number on a fixed scale, and the sketch of a group is the count of every
such number: at most ``TOP + 1`` counters per metric, whose sums merge exactly, in
any order, so quantiles are good to one step of the scale. The cuts are fences
around the quartiles (``REACH`` times their distance, which is at least a floor
per metric). A group with fewer than ``LEAST`` texts takes the merged sketch of
its language, and if that is small too, of all texts.

Only DataFrame functions are used. Defined cases: null text has no words and
fails; null language or source is a group of its own; equal rows get equal
answers; with no text of 50 words anywhere there are no cuts; very long texts count
whole, as one row; other columns are not read. Windows are compared by 64-bit hashes of their three words within one
text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from detlake.session import materialize

LEAST = 50
REACH = 3
TOP = 1000
METRICS = {  # metric: least distance of the quartiles, whether low values fail too
    "length": (5, True),
    "symbols": (10, False),
    "lines": (100, False),
    "repeats": (100, False),
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

_SPACE = r"[\x20\x09-\x0D]+"


def _repeated(window: Column) -> Column:
    """Windows, as sorted (hash, place) pairs, whose hash a neighbour shares."""
    def shared(x, k):
        before, after = F.get(window, k - 1)["h"], F.get(window, k + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    return F.filter(window, shared)


def base_metrics(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``source``, the ``BASE`` counts, ``n_lines`` and ``base_failed`` of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split(text, _SPACE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    words, lines = F.col("_words"), F.col("_lines")
    hashed = F.transform(
        words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    rows = rows.withColumn("_sorted", F.sort_array(F.slice(hashed, 1, F.greatest(F.size(words) - 2, F.lit(0)))))
    rows = rows.withColumn("_at", F.sort_array(F.transform(_repeated(F.col("_sorted")), lambda x: x["i"])))
    covered = F.transform("_at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_at", k + 1) - p, F.lit(3))))
    n_words = F.size(words).cast("long")
    repeat = F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select(
        "doc_id", "lang", "source",
        n_words.alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat.alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
    ).withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _scaled() -> Column:
    """The four metrics as whole numbers from 0 to ``TOP``."""
    return F.expr(f"""struct(
        least(10 * word_chars div n_words, {TOP}L) as length,
        least(1000 * n_symbols div word_chars, {TOP}L) as symbols,
        1000 * n_dup_lines div n_lines as lines,
        1000 * n_repeat_words div n_words as repeats)""")


def sketches(scaled: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group, metric and value: sketches that merge by adding up."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return scaled.select(*by, F.inline(values)).groupBy(*by, "metric", "value").agg(F.count("*").alias("n"))


def _fences(counts: DataFrame, by: list[str]) -> DataFrame:
    """Lowest and highest passing value per group and metric, and the texts they rest on."""
    group = Window.partitionBy(*by, "metric")
    running = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    at = counts.withColumn("upto", running).withColumn("of", F.sum("n").over(group))
    quartiles = at.groupBy(*by, "metric").agg(
        F.first("of").alias("of"),
        F.min(F.when(F.expr("4 * upto >= of"), F.col("value"))).alias("q1"),
        F.min(F.when(F.expr("4 * upto >= 3 * of"), F.col("value"))).alias("q3"),
    )
    floor = reduce(lambda c, m: c.when(F.col("metric") == m, METRICS[m][0]), METRICS, F.when(F.lit(False), 0))
    both = F.col("metric").isin([m for m, (_, low) in METRICS.items() if low])
    reach = REACH * F.greatest(F.col("q3") - F.col("q1"), floor)
    return quartiles.select(
        *by, "metric", "of", F.when(both, F.col("q1") - reach).otherwise(-1).alias("low"),
        (F.col("q3") + reach).alias("high"),
    )


def _grouped(metrics: DataFrame) -> DataFrame:
    """Language and source as ``_lang`` and ``_source`` that are never null."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    return metrics.withColumns({"_lang": name("lang"), "_source": name("source")})


def thresholds(metrics: DataFrame) -> DataFrame:
    """One row per ``_lang`` and ``_source``: ``low_<metric>`` and ``high_<metric>``."""
    good = _grouped(metrics).filter("not base_failed").select("_lang", "_source", _scaled().alias("m"))
    own = materialize(sketches(good.select("_lang", "_source", "m.*"), ["_lang", "_source"]), "rules-sketches")
    out = own.select("_lang", "_source", "metric").distinct()
    for level, by in enumerate((["_lang", "_source"], ["_lang"], [])):
        merged = own.groupBy(*by, "metric", "value").agg(F.sum("n").alias("n"))
        out = out.join(_fences(merged, by).withColumnsRenamed({c: f"{c}{level}" for c in ("of", "low", "high")}), [*by, "metric"])
    first, second = F.col("of0") >= LEAST, F.col("of1") >= LEAST
    pick = lambda c: F.when(first, F.col(f"{c}0")).when(second, F.col(f"{c}1")).otherwise(F.col(f"{c}2"))
    cut = [F.max(F.when(F.col("metric") == m, pick(c))).alias(f"{c}_{m}") for m in METRICS for c in ("low", "high")]
    return out.groupBy("_lang", "_source").agg(*cut)


def judge(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``."""
    metrics = materialize(base_metrics(docs), "rules-metrics")
    cuts = materialize(thresholds(metrics), "rules-cuts")
    judged = _grouped(metrics).join(cuts, ["_lang", "_source"], "left")
    judged = judged.withColumn("_m", F.when(~F.col("base_failed"), _scaled()))
    inside = reduce(
        lambda c, m: c & F.col(f"_m.{m}").between(F.col(f"low_{m}"), F.col(f"high_{m}")), METRICS, F.lit(True))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"))


ORACLE = f"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
win as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k
  from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, k) c from win) where c > 1),
cov as (select rid, count(distinct i + j) n from rep, (values (0), (1), (2)) o(j) group by rid),
b as (select w.rid, doc_id, lang, source, cast(len(ws) as bigint) n_words,
  cast(length(array_to_string(ws, '')) as bigint) word_chars,
  cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
  cast(coalesce(n, 0) as bigint) n_repeat_words, cast(len(ls) as bigint) n_lines
  from w left join cov using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from b),
s as (select rid, lang, source, least(10 * word_chars // n_words, {TOP}) length,
  least(1000 * n_symbols // word_chars, {TOP}) symbols, 1000 * n_dup_lines // n_lines lines,
  1000 * n_repeat_words // n_words repeats from f where not base_failed),
l as (select rid, lang, source, metric, value from s unpivot (value for metric in (length, symbols, lines, repeats))),
lev as (select 0 lv, lang, source, metric, value from l union all select 1, lang, null, metric, value from l
  union all select 2, null, null, metric, value from l),
q as (select lv, lang, source, metric, count(*) n, quantile_disc(value, 0.25) q1, quantile_disc(value, 0.75) q3
  from lev group by all),
c as (select *, {REACH} * greatest(q3 - q1, case metric {' '.join(f"when '{m}' then {v[0]}" for m, v in METRICS.items())} end) r from q),
e as (select *, case when metric = 'length' then q1 - r else -1 end low, q3 + r high from c),
bad as (select distinct l.rid from l
  left join e e0 on e0.lv = 0 and e0.lang is not distinct from l.lang and e0.source is not distinct from l.source and e0.metric = l.metric
  left join e e1 on e1.lv = 1 and e1.lang is not distinct from l.lang and e1.metric = l.metric
  left join e e2 on e2.lv = 2 and e2.metric = l.metric
  where case when e0.n >= {LEAST} then value not between e0.low and e0.high
    when e1.n >= {LEAST} then value not between e1.low and e1.high else value not between e2.low and e2.high end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and bad.rid is null kept from f left join bad using (rid)
"""
