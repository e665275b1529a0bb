import random

import pytest
from conftest import ordered

import brute
from turnloom.llm import html_diff as hd
from turnloom.llm import queries


def text_of(html, neighbours=(), usual=None):
    lines, marks = hd.page_lines(html)
    return "\n".join(hd.main_lines(lines, marks, [hd.page_lines(n)[0] for n in neighbours], usual)[0])


@pytest.mark.parametrize("size", [1 << 22, 1])
def test_alignment_is_longest(monkeypatch, size):
    monkeypatch.setattr(hd, "_WHOLE_TABLE", size)
    rng = random.Random(size)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
        shared = hd.shared_lines(a, b)
        kept = [x for x, s in zip(a, shared) if s]
        rest = iter(b)
        assert all(x in rest for x in kept)  # a subsequence of b
        assert len(kept) == brute.lcs(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="no-sidebar">
<header><a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><!-- <p>no</p> -->
<div class="ad">Buy {n}</div><div id="cookie-notice">We use cookies</div>
<article class="post"><header><h1>Title &amp; {n}</h1></header><p>First&nbsp;<b>bold
 text</b> of {n}<br><p>Second &lt;p&gt; one<ul><li>item a<li>item b</ul><aside>See also</aside><form><input name=q>Search</form>
<section class="comments"><p>Nice post {n}</p></section></article>
<div class="sidebar widget"><p>Tags</p></div><footer>&copy; {n}</footer></body></html>"""


def test_article():
    assert text_of(PAGE.format(n=7)) == "Title & 7\nFirst bold text of 7\nSecond <p> one\nitem a\nitem b"


def test_article_shared_with_a_copy_stays():
    page = PAGE.format(n=7)
    assert text_of(page, [page]) == text_of(page)


PLAIN = "<html><body><div>Site name</div><div>All topics</div><h2>{t}</h2><div>{a}</div><div>{b}</div><div>Imprint</div></body></html>"


def test_differencing_without_an_article():
    page = PLAIN.format(t="News", a="Something happened today.", b="Then more of it.")
    near = PLAIN.format(t="Sports", a="Someone won.", b="Someone lost.")
    assert text_of(page, [near]) == "News\nSomething happened today.\nThen more of it."
    assert text_of(page, [page, near]) == text_of(page, [near])  # a copy is no template
    assert text_of(page, [page]) == text_of(page)
    assert text_of(page).startswith("Site name")


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("a < b & c", "a < b & c"), ("<p>x", "x"), ("<p", ""), ("<!-- x", ""),
        ("<script>x", ""), ("<p>a</p\n>b", "a\nb"), ("<p title='>'>a", "a"), ('<p title="x>a', "a"), ("<p>a <span class=ad>b</span> c", "a c"), ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<main>a<nav>n</nav></main>b", "a"), ("<article>a</article><article class=comment>b</article>", "a"),
        ("&#x41;&#65;&eacute;&nosuch;", "AAé&nosuch;"), ("<p class=ad>x<p>y", "y"), ("<table><tr><td>a<td>b</table>", "a\nb"),
        ("<div hidden>x</div><div style='display: none'>y</div>z", "z"), ("<svg><text>x</text></svg>y", "y"),
    ],
)
def test_small_pages(html, text):
    assert text_of(html) == text


def test_long_pages_take_linear_time():
    assert text_of("<" * 200_000) != None  # noqa: E711
    assert text_of("<p>a" * 20_000).count("\n") == 19_999
    lines = [str(i % 50) for i in range(6000)]
    assert sum(hd.shared_lines(lines, lines[::2])) >= 3000


def pages(spark):
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.example/{i % 7}/{i}?q={i}", PLAIN.format(t=f"T{i}", a=f"a{i}", b=f"b{i}")) for i in range(300)]
    rows += [(1000, None, PLAIN.format(t="x", a="y", b="z")), (1001, "http://alone.example/", PAGE.format(n=1)),
             (1002, "http://h0.example/", None), (1003, "", ""), (3, rows[3][1], rows[3][2]), (None, "x", "<p>a")]
    clash = ["key", "lines", "bucket", "text", "host", "guest"]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *[f"'clash' as {c}" for c in clash])
    return df.repartition(4)


@pytest.mark.parametrize("per_bucket", [2000, 7])
def test_neighbours_do_not_depend_on_buckets(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(hd, "_PAGES_PER_BUCKET", per_bucket)
    df = pages(spark)
    rows = [(r["page_id"], r["url"], r["html"]) for r in df.collect()]
    split = lambda u: hd.re.match(r"(?:[a-z]+://([^/?#]*))?([^?#]*)", u or "").groups(default="")
    placed = sorted(((*split(u), k is not None, k or 0), k, u, h) for k, u, h in rows)
    hosts = {}
    for place, _, _, h in placed:
        hosts.setdefault(place[0], []).append(set(x for x, m in zip(*hd.page_lines(h)) if m in "am"))
    usual = {host: [hd.line_hash(x) for x in set().union(*pages) if 2 * sum(x in p for p in pages) > len(pages) >= 3] for host, pages in hosts.items()}
    expected = []
    for i, (place, k, u, h) in enumerate(placed):
        beside = [placed[j] for j in (i - 1, i + 1) if 0 <= j < len(placed) and placed[j][0][0] == place[0]]
        beside.sort(key=lambda p: -hd._prefix(p[0][1], place[1]))
        text = text_of(h, [p[3] for p in beside], usual[place[0]])
        expected.append((k, u, text, len(text)))
    got = hd.extract(df).select("page_id", "url", "text", "n_chars").collect()
    assert ordered(got) == ordered(expected)
    assert hd.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query(spark, sf):
    """The whole article of every page, whoever lies beside it."""
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_html_diff(spark, sf).collect()
    assert len(rows) == len(html)
    for r in rows:
        inner = html[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = hd.re.split(r"</?(?:h1|p)>", hd.re.sub(r"<(?:br|/?b)>", " ", inner))
        expected = "\n".join(filter(None, (" ".join(hd.unescape(b).split()) for b in blocks)))
        assert r["text"] == expected and r["n_chars"] == len(expected)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div class='layout has-sidebar'><article>a<p>b</article></div>", "a\nb"),
        ("<div class='layout no-sidebar'><main>a</main><div class=sidebar>s</div></div>", "a"),
        ("<div id='share-price'>a</div>", "a"), ("<article class='post comments-open'>a</article>b", "a"),
        ("<div class='widget'>x<article>a<div class=ad>b</div>c</article>y</div>z", "a\nc"),
        ("<div class='banner'><div>a</div></div>", "a"), ("<div class=ad>x</div><div>a</div>", "a"),
        ("<div id=comments><article>c</article></div><article>a</article>", "a"), ("<nav><article>n</article></nav>a", "a"),
    ],
)
def test_class_words_do_not_lose_articles(html, text):
    assert text_of(html) == text


def test_lines_under_class_words_are_differenced():
    page, near = (f"<div class='banner'><p>Site</p><p>text {i}</p></div>" for i in (1, 2))
    assert text_of(page, [near]) == "text 1"


HOSTED = "<main><p>Topics</p><p>{m}</p><article><p>{a}</p><p>{b}</p><p>Read more</p></article></main>"


def test_differencing_decides_before_structure():
    page, before, after = (HOSTED.format(m=f"main {i}", a=f"long text {i}", b=f"and more {i}") for i in range(3))
    assert text_of(page, [before, after]) == "main 0\nlong text 0\nand more 0"
    assert text_of(page, [page, page]) == text_of(page)  # copies are no template
    quoting = HOSTED.format(m="x", a="long text 0", b="other")
    assert text_of(page, [quoting, after]) == "main 0\nlong text 0\nand more 0"


def test_only_what_most_pages_repeat_leaves_an_article(spark):
    """A line that two neighbours share by chance stays, headings stay, a line of all articles goes."""
    page = "<html><body><nav>menu</nav><article><h2>Method</h2><p>{own}</p><p>{chance}</p><p>Read more</p></article></body></html>"
    rows = [(i, f"http://h/{i:03d}", page.format(own=f"own {i}", chance="Les." if 10 <= i < 14 else f"only {i}")) for i in range(40)]
    got = hd.extract(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
    for r in got:
        i = r["page_id"]
        assert r["text"] == f"Method\nown {i}\n" + ("Les." if 10 <= i < 14 else f"only {i}")
    few = hd.extract(spark.createDataFrame(rows[:2], "page_id int, url string, html string")).collect()
    assert all(r["text"].endswith("Read more") for r in few)


@pytest.mark.parametrize("inside", [
    "<div class='comments-area'>x</div>", "<ol class='comment-list'><li>x</ol>", "<div class='ad-slot'>x</div>",
    "<div class=share-buttons>x</div>", "<div class='related-posts'>x</div>", "<div class='post_comments'>x</div>",
    "<div class='comments-area'><article class='comment-body'>x</article></div>",
])
def test_class_words_beside_hyphens(inside):
    assert text_of(f"<article>a{inside}<p>b</article>") == "a\nb"


@pytest.mark.parametrize("html, text", [
    ("<div class=site-nav>n</div><div class=site-footer>f</div><div class='cookie-banner'>c</div><div>a</div>", "a"),
    ("<article><div class='no-ads with-sidebar'>a</div><section id='related-work'><h2>b</h2></section></article>", "a\nb"),
    ("<article><h2 id='share-price'>a</h2><p class='comments-closed'>b</article>", "a\nb"),
    ("<article>a <math><mi>x</mi></math> b</article>", "a x b"),
])
def test_states_and_ids_are_no_class_words(html, text):
    assert text_of(html) == text


def test_a_teaser_does_not_replace_the_main_text():
    page = "<main><p>the whole text</p><article>teaser</article></main>"
    assert text_of(page) == "the whole text\nteaser"
