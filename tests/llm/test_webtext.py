import random

import pytest
from pyspark.sql import functions as F

from detlake.llm import webtext

PAGES = "page_id bigint, url string, html string, host string, path string, whole string, lines int, gone int, part int, n_chars int"


def _main(spark, rows, parts=3):
    pages = spark.createDataFrame([(*r, "h", "p", "w", 1, 2, 3, 4) for r in rows], PAGES).repartition(parts)
    found = webtext.main_text(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


def _longest(x, y):
    table = [[0] * (len(y) + 1)]
    for a in x:
        row = [0]
        for j, b in enumerate(y):
            row.append(table[-1][j] + 1 if a == b else max(table[-1][j + 1], row[j]))
        table.append(row)
    return table[-1][-1]


@pytest.mark.parametrize("cells", [webtext.CELLS, 6])
def test_alignment_is_a_longest_common_subsequence(monkeypatch, cells):
    monkeypatch.setattr(webtext, "CELLS", cells)
    rng = random.Random(1)
    for _ in range(600):
        x, y = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in range(2))
        at, rest = webtext.shared(x, y), iter(y)
        assert at == sorted(set(at)) and len(at) == _longest(x, y) and all(x[i] in rest for i in at)


def test_given_pages_are_their_articles(spark):
    """Against the text of ``article`` read by SQL functions; the given pages all have one."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    inside = F.regexp_extract("html", r"(?s)<article>(.*?)</article>", 1)
    blocks = F.transform(F.split(inside, "</?(?:p|h1)>"), lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, "<[^>]*>", ""), r"\s+", " ")))
    want = pages.select("page_id", F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n").alias("text"))
    for escaped, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;?", "&")):
        want = want.withColumn("text", F.regexp_replace("text", escaped, plain))
    got = webtext.main_text(pages)
    assert got.count() == pages.count()
    assert got.select("page_id", "text").exceptAll(want).count() == 0


ARTICLE = "<article><header><h1>T&eacute;</h1></header><p>One&nbsp;\n two<br>three<p>Four <span class=ad>buy <i>x</i></span>five</article>"


@pytest.mark.parametrize("page, want", [
    (f"<body><nav><p>menu</nav><header>top</header>{ARTICLE}<footer>end", "Té\n\nOne two three\n\nFour five"),
    (f"<body><form>{ARTICLE}<div id=comments><p>me too</div></form>", "Té\n\nOne two three\n\nFour five"),
    ("<main><h1>A</h1><article>b<aside>c</aside><section class='reader-comments'>d</section><article>e</article></article></main>", "A\n\nb"),
    ("<div class='cookie-notice'>ok</div><div class='post-content'>x<script>var a='</p>'</script><style>p{}</style><div class=sidebar>y</div></div>z", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table><!-- f", "a\n\nb\n\nc d\n\ne"),
    ("<p>a &lt;b&gt; &#x41;&#66; &amp &unknown; <b>c</p>d", "a <b> AB & &unknown; c\n\nd"),
    ("<head><title>t<p>x</title><meta name=a><p hidden>no</p><p style='display: none'>no</p><div role=navigation>no</div><textarea>no</textarea>yes", "yes"),
    ("plain <3 text > here", "plain <3 text > here"), ("<a href='x>y'>k</a>", "k"), ("", ""), ("<p> \n</p>", ""), (None, ""),
    ("<script>never closed <p>x", ""), ("<p title=\"never closed>x", "x"),
])
def test_markup(spark, page, want):
    lines, _ = webtext.lines(page or "")
    assert "\n\n".join(lines) == want


def test_shared_lines_of_nearest_pages_go_where_nothing_marks_the_article(spark):
    def page(i, extra=""):
        return f"<div><p>Home</p><p>Weather {i // 40}</p></div><div><p>Story {i} is told</p><p>and {i * 7} more words follow here</p>{extra}</div><div><p>Imprint</p></div>"

    rows = [(i, f"http://a.example/{'news' if i % 2 else 'blog'}/{i:03d}", page(i)) for i in range(80)]
    rows += [(100, "http://b.example/x", page(3)), (101, "http://A.example/news/001/copy", page(1)), (102, None, page(5)), (102, "no", page(6))]
    got = _main(spark, rows)
    assert len(got) == 83
    for i in range(80):
        assert got[i] == f"Story {i} is told\n\nand {i * 7} more words follow here"
    assert got[100] == "Home\n\nWeather 0\n\nStory 3 is told\n\nand 21 more words follow here\n\nImprint"  # no other page of its host
    assert got[101] == got[1]
    assert "Home" not in got[102]


def test_copies_and_marked_articles_stay_whole(spark):
    text = "".join(f"<p>Paragraph {k} of the copied story</p>" for k in range(9))
    near = [(i, f"http://c.example/{i}", f"<div>{text}<p>{i}</p></div>") for i in range(3)]
    same = [(10 + i, f"http://d.example/{i}", f"<div>{text}</div>") for i in range(4)]
    marked = [(20 + i, f"http://e.example/{i}", f"<p>menu</p><article>{text}<p>{i}</p></article>") for i in range(3)]
    got = _main(spark, near + same + marked)
    whole = "\n\n".join(f"Paragraph {k} of the copied story" for k in range(9))
    assert all(got[i] == f"{whole}\n\n{i}" and got[20 + i] == got[i] for i in range(3))
    assert all(got[10 + i] == whole for i in range(4))


def test_notices_inside_marked_articles_go_by_differencing_and_shared_passages_stay(spark):
    def page(i):
        passage = "<p>A passage that some stories quote</p>" if i % 6 < 2 else ""
        return f"<article><h1>Story {i}</h1><p>Told at length, part {i}</p>{passage}<p>Get our daily letter</p></article>"

    rows = [(i, f"http://f.example/{i:02d}", page(i)) for i in range(12)]
    rows += [(20 + i, f"http://g.example/{i:02d}", page(i)) for i in range(webtext.PAGES - 1)]
    got = _main(spark, rows)
    for i in range(12):
        want = f"Story {i}\n\nTold at length, part {i}" + "\n\nA passage that some stories quote" * (i % 6 < 2)
        assert got[i] == want
    assert all(got[20 + i].endswith("Get our daily letter") for i in range(webtext.PAGES - 1))  # too few pages to tell


def test_ranges_of_one_host_agree_with_one_range(spark):
    rows = [(i, f"http://a.example/{i % 7}/{i:04d}", f"<p>Menu {i // 100}</p><p>Text {i}</p><p>and its longer second line {i}</p><p>Foot</p>") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = _main(spark, rows, 1)
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert _main(spark, rows, 5) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_pages_and_very_long_ones(spark):
    assert _main(spark, [], 1) == {}
    long = "<p>" + "</p><p>".join(f"line {i % 1000} {i}" for i in range(60_000)) + "</p>"
    got = _main(spark, [(1, "http://x.example/1", "<p>menu of all pages</p>" + long), (2, "http://x.example/2", "<p>menu of all pages</p><p>Other</p><p>words here that are its own</p>"), (3, "http://x.example/3", None)])
    assert got[1].count("\n\n") == 59_999 and got[3] == "" and got[2] == "Other\n\nwords here that are its own"
