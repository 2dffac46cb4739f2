"""URL filter: listed rules first, association rules mined from labels for the rest.

The words of a URL (host, path, query names, marked by where they stand; numbers
left out) and a ``bad`` mark from the labels are one basket per labelled page.
Words on fewer than ``LEAST`` pages can be in no rule and are left out. FP-growth finds the
frequent combinations; a basket of over ``WIDE`` words goes in as all triples of its groups of
``GROUP`` words, which hold every combination of ``LONGEST`` words, and what is found that way is
counted anew over whole baskets. Rules ``words -> bad`` stay if they rest on ``LEAST`` bad pages, are
right more often than not (``CONFIDENCE``), ``LIFT`` times as often as pages are bad at all, and so often that
chance would not do it (``SURE`` standard errors over that rate, as many words are looked at),
and if no smaller rule is at least as sure. A page is blocked
if some rule's words are all in its URL. Each rule is indexed under its rarest
word; a URL looks up its words there and checks the few rules it finds.

Listed rules are a short configuration of (verdict, host and path): a rule fits
its host and all subdomains if the path starts with the rule's path; the longest
wins, and it overrides the mined ones.

Defined cases: null URL or one without ``://`` has empty host and path, no rule, and
is allowed; no labels or no frequent words: nothing is mined; equal URLs get equal
verdicts; a document labelled twice is bad if one label says so; very long URLs count with
all their words; of rules that are equally sure any may name the verdict; other columns are
not read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from detlake.session import materialize

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
LEAST = 20  # bad pages a rule must rest on, whatever the size of the table
CONFIDENCE = 0.5
LIFT = 1.5
SURE = 5.0
LONGEST = 3  # words in a rule
GROUP, WIDE = 4, 12
_BAD = "!bad"


def _upper_to_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return _upper_to_lower(F.coalesce(found, F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(url_host: Column, url_path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = (url_host == name) | url_host.endswith("." + name)
        fits &= url_path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def words(url: Column) -> Column:
    """Distinct words of a URL, marked h (host), p (path) or q (query name)."""
    def marked(mark: str, text: Column) -> Column:
        parts = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: (w != "") & ~w.rlike(r"^\p{N}+$"))
        return F.transform(parts, lambda w: F.concat(F.lit(mark), w))

    query = F.regexp_replace(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), r"=[^&]*", "")
    found = F.array_distinct(F.concat(marked("h:", host(url)), marked("p:", path(url)), marked("q:", query)))
    return F.coalesce(found, F.array().cast("array<string>"))


def document_of(url: Column) -> Column:
    """The first number that is a whole path segment, without its ending: the document's id."""
    digits = F.regexp_extract(url, r"/(\d{1,18})(?:[./?#]|$)", 1)
    return F.when(digits != "", digits).try_cast("bigint")


def _narrow(words_of: Column) -> Column:
    """Baskets of at most ``WIDE`` words that together hold all combinations of ``LONGEST`` words."""
    n = F.ceil(F.size(words_of) / F.lit(GROUP)).cast("int")
    group = lambda i: F.slice(words_of, i * GROUP + 1, F.lit(GROUP))
    below = lambda k: F.sequence(F.lit(0), k - 1)
    triples = F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.flatten(F.transform(
        F.sequence(F.lit(1), i - 1), lambda j: F.transform(below(j), lambda k: F.concat(group(i), group(j), group(k)))))))
    return F.when(F.size(words_of) > WIDE, triples).otherwise(F.array(words_of))


def _rarest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rule`` and ``need`` with the rarest of its words as ``key``."""
    keyed = rules.withColumn("key", F.explode("need")).join(counts, "key")
    return keyed.groupBy("need").agg(F.min(F.struct("n", "key"))["key"].alias("key")).withColumn("rule", F.xxhash64("need"))


def mine(baskets: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT, sure: float = SURE) -> DataFrame:
    """Rules ``rule``, ``need`` (words), ``confidence``, ``key`` (rarest word) from ``words`` and ``bad``."""
    spark = baskets.sparkSession
    baskets = materialize(baskets.select(F.monotonically_increasing_id().alias("id"), "words", "bad"), "urls-baskets")
    none = spark.createDataFrame([], "rule bigint, need array<string>, confidence double, key string")
    total = baskets.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    if total["bad"] < least:
        return none
    base = total["bad"] / total["n"]
    counts = baskets.select("bad", F.explode("words").alias("key")).groupBy("key").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("n_bad")).filter(F.col("n_bad") >= least)
    counts = materialize(counts, "urls-words")
    held = baskets.select("id", "bad", F.explode("words").alias("key")).join(counts.select("key"), "key")
    held = held.groupBy("id", "bad").agg(F.sort_array(F.collect_list("key")).alias("words"))
    items = held.select("bad", F.explode(_narrow(F.col("words"))).alias("items"))
    mark = F.when(F.col("bad"), F.array(F.lit(_BAD))).otherwise(F.array().cast("array<string>"))
    items = materialize(items.select(F.concat("items", mark).alias("items")), "urls-items")
    n_items = items.count()
    if not n_items:
        return none
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n_items * (1 - 1e-9)), minConfidence=0.0).fit(items)
    found = model.freqItemsets.filter(F.array_contains("items", _BAD) & (F.size("items") > 1) & (F.size("items") <= LONGEST + 1))
    rules = _rarest(found.select(F.sort_array(F.array_remove("items", _BAD)).alias("need")), counts.select("key", "n"))
    rules = materialize(rules, "urls-candidates")
    exact = _hits(baskets, rules).groupBy("rule", "need", "key").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    share = F.col("n_bad") / F.col("n")
    chance = F.lit(base) + F.lit(sure) * F.sqrt(F.lit(base * (1 - base)) / F.col("n"))
    strong = (F.col("n_bad") >= least) & (share >= confidence) & (share >= lift * base) & (share >= chance)
    keyed = materialize(exact.filter(strong).select("rule", "need", share.alias("confidence"), "key"), "urls-rules")
    smaller = _hits(keyed.select(F.col("rule").alias("id"), F.col("need").alias("words"), F.col("confidence").alias("own")), keyed)
    worse = smaller.filter((F.col("id") != F.col("rule")) & (F.col("confidence") >= F.col("own"))).select(F.col("id").alias("rule"))
    return keyed.join(worse.distinct(), "rule", "left_anti")


def _hits(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``rows`` (with ``words``) and each rule whose words they all have, by the index on the rarest word."""
    asked = rows.withColumn("key", F.explode("words"))
    return asked.join(rules, "key").filter(F.size(F.array_except("need", "words")) == 0)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``mined`` (surest mined rule's confidence) per page."""
    urls = materialize(pages.select("page_id", "url"), "urls-pages")
    marks = labels.groupBy("doc_id").agg(F.max(F.expr("coalesce(quality = 0, false) or coalesce(toxic = 1, false)")).alias("bad"))
    known = urls.select("url", document_of(F.col("url")).alias("doc_id")).join(marks, "doc_id")
    found = mine(known.select(words(F.col("url")).alias("words"), "bad"))
    distinct = urls.select("url").distinct().withColumn("words", words(F.col("url")))
    mined = _hits(distinct, found).groupBy("url").agg(F.max("confidence").alias("mined"))
    judged = urls.join(materialize(mined, "urls-mined"), "url", "left")
    judged = judged.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "mined")
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("mined").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_method).alias("verdict"), "mined")
