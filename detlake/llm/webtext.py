"""Main text of web pages: markup tells what it can, nearest pages of the host tell the rest.

A page becomes text lines (one per block) in page order. Lines of elements that are
never article text (navigation, footers, asides, forms, scripts, hidden parts, and
elements whose class, id or role says advert, notice, sidebar, comments and the like)
go at once, and where the page marks its article (``article``, ``main``, ``articleBody``, or a
class or id such as ``post`` or ``content``), the lines outside. What is left of all pages
is differenced: pages of a host are put in order of their URL path, each is paired with its
nearest neighbour on either side that holds other lines, lines are aligned by a longest common
subsequence, and the lines both hold are deleted. A pair that shares over
``COPY`` of the characters of either page is a near copy and deletes nothing. Inside a marked
article a passage that two stories share is text, so a check follows there: deleted lines
come back unless at least ``MOST`` of the different pages of the host hold them, of ``PAGES`` or more;
those are the notices of the site.

Only line hashes and lengths are moved to pair pages, one row per host and different
sequence of lines; hosts are cut into ranges of paths, so a host of a third of all pages is many tasks.
The texts join the deleted lines once, and stay in place where few pages have any.

Defined cases: null, empty or text-less html has empty text; null URLs and such without
``://`` share one empty host; equal pages of a host are paired as one; rows that share a
``page_id`` are each extracted; unclosed tags, comments and quotes end with the page; a
very long page is worked on alone; other columns are not read; no pages give no rows.
White space is what Unicode says, no-break spaces included.
"""

from __future__ import annotations

import collections
import html
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from detlake.llm.urls import host, path
from detlake.session import broadcast_if_small, materialize

COPY = 0.7
MOST, PAGES = 0.5, 8  # share of a host's different pages that hold a notice, and how many pages can tell
CELLS = 1 << 27  # bits of one alignment table; longer pages are aligned in halves

# --- lines of one page ---------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|textarea|select|title|noembed|noframes|xmp)(?=[\s/>])"
    r"(?:(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b", re.S)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "tfoot thead tr ul".split())
_PLAIN = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup tt u var".split())
_ENDS_P = _BLOCKS - {"body", "html", "head", "caption", "legend", "tbody", "tfoot", "thead", "tr", "option", "optgroup"}
_ENDS_SELF = frozenset("li dd dt tr option".split())
_CHROME = frozenset("nav footer aside menu form button dialog head datalist label input".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_SAYS_CHROME = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead topbar cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup signin login comment comments disqus respond reply replies "
    "discussion share sharing social related recommended recommendations pagination pager widget widgets toolbar searchform".split())
_SAYS_ADVERT = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors".split())
_SAYS_ARTICLE = frozenset("article articlebody content contents post entry story maincontent postbody".split())
_NEGATED = frozenset("no with without has".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[^A-Za-z0-9]+")

_TEXT, _HINTED, _ARTICLE, _DROPPED = range(4)


def _says(attrs: str, inline: bool) -> tuple[bool, bool, bool, bool]:
    """Whether attributes tell page furniture, a page header, an article, and what may be one."""
    chrome = header = article = hint = False
    furniture = _SAYS_ADVERT if inline else _SAYS_CHROME
    for name, a, b, c, bare in _ATTR.findall(attrs):
        name, value = (name or bare).lower(), a or b or c
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _CAMEL.split(one) if w}
                if not words & _NEGATED:
                    chrome |= bool(words & furniture)
                    header |= "header" in words
                    hint |= bool(words & _SAYS_ARTICLE) or one.lower() in _SAYS_ARTICLE
        elif name == "role":
            chrome |= value.lower() in _ROLES
            article |= value.lower() in ("main", "article")
        elif name == "itemprop":
            article |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            chrome = True
        elif name == "style":
            chrome |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return chrome, header, article, hint


def _state(tag: str, attrs: str, above: int, in_form: bool, nested: bool) -> tuple[int, bool]:
    """What the text of an element is, from what it stands in; the second: dropped for a form around it."""
    says = _says(attrs, tag in _PLAIN) if attrs and tag not in ("html", "body") else (False,) * 4
    chrome, header, article, hint = says
    if above == _DROPPED:
        around = in_form and tag in ("article", "main") and not chrome
        return (_ARTICLE, False) if around else (_DROPPED, in_form)
    if tag in ("article", "main"):
        return (_DROPPED, False) if chrome or nested else (_ARTICLE, False)
    if tag == "form":
        return _DROPPED, True
    if tag in _CHROME or chrome or ((tag == "header" or header) and above < _HINTED):
        return _DROPPED, False
    return max(above, _ARTICLE if article else _HINTED if hint else _TEXT), False


def lines(page: str) -> tuple[list[str], bool]:
    """The text lines of a page that its markup leaves, and whether it marks them as the article."""
    stack: list[tuple[str, int, bool]] = []
    found: list[tuple[str, int]] = []
    parts: list[str] = []
    state = own = _TEXT
    seen = False

    def flush():
        nonlocal seen
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, own))
                seen = seen or any(s[0] == "article" for s in stack)
            parts.clear()

    at = 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and state != _DROPPED:
            parts.append(page[at:token.start()])
            own = state
        at = token.end()
        if token["tag"] is None:
            continue
        tag, attrs = token["tag"].lower(), token["attrs"]
        inline = tag in _PLAIN
        if inline and state != _DROPPED and not token["end"] and "=" not in attrs:
            continue
        if tag in _BLOCKS:
            flush()
        elif tag in ("br", "td", "th", "img") and state != _DROPPED:
            parts.append(" ")
        if token["end"]:
            names = [s[0] for s in stack]
            if tag not in names:
                continue
            del stack[len(names) - 1 - names[::-1].index(tag):]
        elif tag == "body":
            stack = [("body", _TEXT, False)]
        elif tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCKS):
            if stack and ((tag in _BLOCKS and stack[-1][0] == "head") or (tag in _ENDS_P and stack[-1][0] == "p")
                          or (tag in _ENDS_SELF and stack[-1][0] == tag)):
                stack.pop()
            above, in_form = stack[-1][1:] if stack else (_TEXT, False)
            nested = tag == "article" and seen and any(s[0] == "article" for s in stack)  # comments of readers
            new, by_form = _state(tag, attrs, above, in_form, nested)
            if inline and new != _DROPPED:  # inline elements count only where they hide text
                continue
            stack.append((tag, new, by_form))
        now = stack[-1][1] if stack else _TEXT
        if now != state:
            if not inline:
                flush()
            state = now
    if state != _DROPPED and at < len(page):
        parts.append(page[at:])
        own = state
    flush()
    most = max((s for _, s in found), default=_TEXT)
    return [t for t, s in found if s == most], most > _TEXT


# --- differencing ----------------------------------------------------------------

def _rows(x: list, y: list):
    """Bit rows of the table of longest common subsequences, one per element of ``x``; a zero bit is a step."""
    places: dict = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = row = (1 << len(y)) - 1
    for v in x:
        hit = row & places.get(v, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _last_lengths(x: list, y: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with every beginning of ``y``."""
    row = collections.deque(_rows(x, y), maxlen=1)[0]
    data = np.frombuffer(row.to_bytes((len(y) + 7) // 8, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(data, bitorder="little")[:len(y)].astype(np.int64))])


def _length(row: int, j: int) -> int:
    return j - (row & ((1 << j) - 1)).bit_count()


def shared(x: list, y: list) -> list[int]:
    """Places of ``x`` on one longest common subsequence with ``y``."""
    both = set(x) & set(y)
    at, y = [i for i, v in enumerate(x) if v in both], [v for v in y if v in both]
    x = [x[i] for i in at]

    def solve(first: int, end: int, low: int, high: int) -> list[int]:
        out = []
        while first < end and low < high and x[first] == y[low]:
            out.append(first)
            first, low = first + 1, low + 1
        tail = []
        while first < end and low < high and x[end - 1] == y[high - 1]:
            tail.append(end - 1)
            end, high = end - 1, high - 1
        if first < end and low < high:
            if (end - first) * (high - low) > CELLS and end - first > 1:  # in halves: memory of two rows
                middle = (first + end) // 2
                left = _last_lengths(x[first:middle], y[low:high])
                right = _last_lengths(x[middle:end][::-1], y[low:high][::-1])[::-1]
                cut = low + int(np.argmax(left + right))
                out += solve(first, middle, low, cut) + solve(middle, end, cut, high)
            else:
                rows = list(_rows(x[first:end], y[low:high]))
                i, j, own = end - first, high - low, []
                while i and j:
                    here = _length(rows[i - 1], j)
                    if (_length(rows[i - 2], j) if i > 1 else 0) == here:
                        i -= 1
                    elif _length(rows[i - 1], j - 1) == here:
                        j -= 1
                    else:
                        own.append(first + i - 1)
                        i, j = i - 1, j - 1
                out += own[::-1]
        return out + tail[::-1]

    return [at[i] for i in solve(0, len(x), 0, len(y))]


def _deleted(own, sizes, other, other_size) -> list[int]:
    """Lines of a page that its neighbour holds in the same order; none if one is a near copy of the other."""
    at = shared(own, other)
    alike = sum(sizes[i] for i in at)
    return [] if alike > COPY * min(sum(sizes), other_size) else at


def _extracted(batches):
    for batch in batches:
        found = [lines(page or "") for page in batch.column(2).to_pylist()]
        hashed = [[xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) - (1 << 63) for t in own] for own, _ in found]
        whole = [xxhash.xxh3_64_intdigest(np.array(h, np.int64).tobytes()) - (1 << 63) for h in hashed]
        yield pa.RecordBatch.from_arrays([
            *batch.columns[:2], pa.array([own for own, _ in found], pa.list_(pa.string())),
            pa.array([m for _, m in found], pa.bool_()), pa.array(whole, pa.int64()), pa.array(hashed, pa.list_(pa.int64())),
            pa.array([[len(t) for t in own] for own, _ in found], pa.list_(pa.int32()))],
            ["page_id", "url", "lines", "marked", "whole", "hashes", "sizes"])


def _ordered(pages: DataFrame) -> DataFrame:
    """Different sequences of lines of each host in order of their least path, and the one before and after: ``host, whole, before, after``."""
    least = pages.groupBy("host", "whole").agg(F.min("path").alias("path"))
    ranges = least.repartitionByRange("host", "path", "whole").withColumn("part", F.spark_partition_id())
    ranges = materialize(ranges, "html-order")  # the range stays with its rows
    own = Window.partitionBy("part").orderBy("host", "path", "whole")
    name = F.struct("host", "whole")
    near = ranges.select("part", "host", "path", "whole", F.lag(name).over(own).alias("before"), F.lead(name).over(own).alias("after"))
    order, key = F.struct("host", "path", "whole"), F.struct("host", "whole")
    ends = ranges.groupBy("part").agg(F.min_by(key, order).alias("first"), F.max_by(key, order).alias("last"))
    parts = Window.orderBy("part")  # one row per range: as many as shuffle partitions
    ends = ends.select("part", F.lag("last").over(parts).alias("last_before"), F.lead("first").over(parts).alias("first_after"))
    near = near.join(F.broadcast(ends), "part")
    before, after = F.coalesce("before", "last_before"), F.coalesce("after", "first_after")
    same = lambda other: F.when(other["host"] == F.col("host"), other["whole"])
    return near.select("host", "whole", same(before).alias("before"), same(after).alias("after"))


def _differences(batches):
    for batch in batches:
        places, keys = [], []
        for own, sizes, other, other_size in zip(*(c.to_pylist() for c in batch.columns[2:])):
            places.append(_deleted(own, sizes, other, other_size))
            keys.append([own[i] for i in places[-1]])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))],
            ["host", "whole", "place", "line"])


def deleted_lines(pages: DataFrame) -> DataFrame:
    """Per host and sequence of lines: the places ``gone`` that its nearest pages hold too, and of those the ``notices`` of the host."""
    near = _ordered(pages)
    sequences = pages.groupBy("host", "whole").agg(F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"))
    sequences = materialize(sequences, "html-sequences")
    asked = near.join(sequences, ["host", "whole"])
    asked = asked.withColumn("other", F.explode(F.array("before", "after"))).filter("other is not null")
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)
    others = sequences.select("host", F.col("whole").alias("other"), F.col("hashes").alias("theirs"), size.alias("their_size"))
    pairs = asked.join(others, ["host", "other"]).select("host", "whole", "hashes", "sizes", "theirs", "their_size")
    found = pairs.mapInArrow(_differences, "host string, whole bigint, place array<int>, line array<bigint>")
    found = found.select("host", "whole", F.inline(F.arrays_zip("place", "line"))).distinct()
    found = materialize(found, "html-shared")

    lines_of = sequences.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    holders = lines_of.join(found.select("host", "line").distinct(), ["host", "line"], "left_semi")
    holders = holders.groupBy("host", "line").agg(F.count("*").alias("n"))
    hosts = sequences.groupBy("host").agg(F.count("*").alias("of"))
    notices = holders.join(hosts, "host").filter((F.col("of") >= PAGES) & (F.col("n") >= MOST * F.col("of")))
    notices = materialize(notices.select("host", "line", F.lit(True).alias("notice")), "html-notices")
    told = found.join(broadcast_if_small(notices), ["host", "line"], "left")
    return told.groupBy("host", "whole").agg(
        F.collect_list("place").alias("gone"), F.collect_list(F.when(F.col("notice"), F.col("place"))).alias("notices"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` (blocks joined by an empty line), ``n_chars``, one row per page."""
    kind, url_kind = (pages.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    schema = (f"page_id {kind}, url {url_kind}, lines array<string>, marked boolean, whole bigint, "
              "hashes array<bigint>, sizes array<int>")
    found = pages.select("page_id", "url", "html").mapInArrow(_extracted, schema)
    found = materialize(found.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), "html-lines")
    gone = materialize(deleted_lines(found.drop("lines")), "html-gone")
    joined = found.drop("hashes", "sizes", "path").join(gone, ["host", "whole"], "left")
    joined = joined.withColumn("gone", F.when(F.col("marked"), F.col("notices")).otherwise(F.col("gone")))
    kept = F.filter("lines", lambda _, i: ~F.array_contains("gone", i))
    text = F.array_join(F.when(F.col("gone").isNull(), F.col("lines")).otherwise(kept), "\n\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
