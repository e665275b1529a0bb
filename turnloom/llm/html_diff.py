"""Main text of web pages by differencing each page with the one nearest by URL.

Pages of one host share a template. Each page is paired with its neighbour in URL order, the
text lines of both are aligned by a longest common subsequence, and shared lines
are deleted. The page's own structure is the exact check that follows: lines inside the
article are put back (a copied article is shared, too) but for those that most pages of the host repeat, and lines that menus, adverts, comments and the
like hold are deleted even where no other page has them.
"""

from __future__ import annotations

import re
from collections.abc import Container, Iterator, Sequence
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import by_value, text_or_empty
from turnloom.plans.ordered import bucket_bounds, bucket_of
from turnloom.plans.scratch import scratch_table

by_value(__name__)

_PAGES_PER_BUCKET = 200
_MAX_BUCKETS = 16_384
_SPREAD = 16
_COPY = 0.8  # a neighbour that shares more of a page than this is a copy, not a template
_WHOLE_TABLE = 1 << 22

# --- structure of one page -------------------------------------------------------

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav"
    " ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_CHROME_TAGS = frozenset(
    "nav aside footer form head menu dialog button select svg math object canvas audio video"
    " fieldset search".split()
)
_CHROME_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar"
    " toolbar tablist".split()
)
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs"
    " comment comments consent cookie cookies copyright disqus footer login masthead menu modal nav"
    " navbar navigation newsletter notice notices pagination popup promo promotion related replies"
    " respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_COMMENT_WORDS = frozenset("comment comments reply replies disqus respond".split())
# What turns the word beside it into a statement about the page: no-sidebar, comments-open.
_STATES = frozenset("no not has have with without is hide show open opened closed on off enabled disabled free".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NONE, _ARTICLE, _MAIN, _CHROME, _WORDY = range(5)  # the last: chrome by its class words only


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    """What an element makes of the text inside it.

    Ids count as whole tokens, as they may be made of headings. Of a class its first and last part
    count (``site-nav``, ``comment-list``), unless a part says that it is a state of the page (``no-sidebar``).
    """
    words: set[str] = set()
    about_comments = False
    role = ""
    if attributes and not attributes.isspace():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                tokens = value.split()
                words.update(tokens)
                for token in tokens if name == "class" else ():
                    parts = re.split("[-_]+", token.strip("-_"))
                    if len(parts) > 1 and _STATES.isdisjoint(parts):
                        words.add(parts[0] if parts[0] in _CHROME_WORDS else parts[-1])
                        about_comments |= parts[0] in _COMMENT_WORDS
            elif name == "role":
                role = value.strip()
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return _CHROME
            elif name == "style" and "display:none" in value.replace(" ", ""):
                return _CHROME
            elif name == "itemprop" and value == "articlebody":
                return _ARTICLE
    if tag in ("html", "body"):
        return _NONE
    if tag == "article" or role == "article":
        return _CHROME if about_comments or words & _COMMENT_WORDS else _ARTICLE
    if tag == "main" or role == "main":
        return _MAIN
    if tag in ("svg", "math") and in_article:
        return _NONE
    if tag in _CHROME_TAGS or role in _CHROME_ROLES or about_comments or words & _COMMENT_WORDS:
        return _CHROME
    if tag == "header" and not in_article:
        return _CHROME
    return _WORDY if words & _CHROME_WORDS else _NONE


def page_lines(html: str | None) -> tuple[list[str], str]:
    """The text lines of a page in order, and one letter for each.

    ``a``: in an article, ``m``: in the main part, ``c``: in a menu, advert, comment or the
    like, ``w``: in what only a class or id calls so, ``u``: anywhere else; ``A`` and ``M`` are headings of
    an article or main part. An article or main part inside an element of the ``w`` kind is one all the same. A line is the text of one block, references decoded and white space
    collapsed; a line break element is white space. Unclosed elements end with their parents.
    """
    lines, marks = [], []
    buffer, aside, wordy = [], [], []  # of the block's own text, and of what it has to be rid of
    stack: list[tuple[str, int, int]] = []  # with the depth of class words that the element suspends
    depth = [0, 0, 0, 0, 0]
    if not html:
        return [], ""

    def flush() -> None:
        own = "a" if depth[_ARTICLE] else "m" if depth[_MAIN] else "u"
        if own != "u" and any(tag in _HEADINGS for tag, _, _ in stack):
            own = own.upper()
        for texts, mark in ((buffer, own), (aside, "c"), (wordy, "w")):
            line = " ".join("".join(texts).split())
            texts.clear()
            if line:
                lines.append(line)
                marks.append(mark)

    def close(at: int) -> None:
        for _, kind, suspended in reversed(stack[at:]):
            depth[kind] -= 1
            depth[_WORDY] += suspended
        del stack[at:]

    def target() -> list[str]:
        return aside if depth[_CHROME] else wordy if depth[_WORDY] else buffer

    def last_open(tag: str, barrier: Sequence[str] = ()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                return i
            if stack[i][0] in barrier:
                break
        return -1

    end, size = 0, len(html)
    while end < size:
        found = _TAG.search(html, end)
        text = html[end : found.start() if found else size]
        if text:
            target().append(unescape(text) if "&" in text else text)
        if not found:
            break
        end = found.end()
        closing, tag, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in _BLOCK:
                flush()
            at = last_open(tag)
            if at >= 0:
                close(at)
            continue
        if tag == "br":
            target().append(" ")
            continue
        if tag in _BLOCK:
            flush()
            at = last_open("p", ("button", "table", "td", "th"))
            if at >= 0:
                close(at)
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                at = last_open(tag, ("ul", "ol", "dl", "table", "menu", "select"))
                if at >= 0:
                    close(at)
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag in _RAW:
            ending = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, end)
            end = ending.end() if ending else size
            continue
        kind = _kind(tag, attributes, depth[_ARTICLE] > 0 or depth[_MAIN] > 0)
        suspended = depth[_WORDY] if kind in (_ARTICLE, _MAIN) else 0
        stack.append((tag, kind, suspended))
        depth[kind] += 1
        depth[_WORDY] -= suspended
    flush()
    return lines, "".join(marks)


# --- differencing ----------------------------------------------------------------


def _rows(a: Sequence, b: Sequence) -> Iterator[int]:
    """Bit-parallel rows: the zero bits below ``j`` of row ``i`` are the LCS length of
    ``a[:i]`` and ``b[:j]``."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    every = row = (1 << len(b)) - 1
    yield row
    for x in a:
        match = row & places.get(x, 0)
        row = (row + match | row - match) & every
        yield row


def _lengths(a: Sequence, b: Sequence) -> list[int]:
    for row in _rows(a, b):
        last = row
    out = [0]
    for bit in reversed(format(last, f"0{len(b)}b")):
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(a: Sequence, b: Sequence) -> list[bool]:
    """For each item of ``a`` whether it is on a longest common subsequence with ``b``.

    Long sequences are halved until the table of bits is small (Hirschberg's way).
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not a or not b:
        inner = [False] * len(a)
    elif len(a) * len(b) <= _WHOLE_TABLE or len(a) == 1:
        inner = [False] * len(a)
        rows = list(_rows(a, b))
        i, j = len(a), len(b)
        while i and j:
            if rows[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if rows[i] >> (j - 1) & 1:
                    inner[i] = True
                    j -= 1
    else:
        half = len(a) // 2
        left, right = _lengths(a[:half], b), _lengths(a[half:][::-1], b[::-1])
        cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        inner = shared_lines(a[:half], b[:cut]) + shared_lines(a[half:], b[cut:])
    return [True] * head + inner + [True] * tail


def line_hash(line: str) -> int:
    import xxhash

    value = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def main_lines(
    lines: Sequence[str], marks: str, neighbours: Sequence[Sequence[str]], usual: Container[int] | None = None
) -> tuple[list[str], int]:
    """The lines that stay, and how many the nearest neighbour shares.

    ``neighbours``: lines of other pages of the host, the nearest first. Shared lines go, then the
    structure corrects this. Only the lines of article and main parts can stay if there are any,
    else those of no known role, else those that only class words call chrome. A neighbour that
    shares nearly all of them is a copy of the page and tells nothing of the template; the
    next one is asked. Article lines, and main lines of a page without an article, are put back
    unless two neighbours that are no copies share them: one alone may quote the text. Where ``usual`` is
    given, the hashes of the lines that most pages of the host have, one such neighbour and that are
    enough. Headings of an article or main part always stay.
    """
    heads = {i for i, m in enumerate(marks) if m in "AM"}
    marks = marks.lower()
    shares = [shared_lines(lines, other) for other in neighbours[:1]]
    n_shared = sum(shares[0]) if shares else 0
    roles = "am" if "a" in marks or "m" in marks else "u" if "u" in marks else "w"
    own = [i for i, m in enumerate(marks) if m in roles]
    body = [i for i in own if marks[i] == ("a" if "a" in marks else "m")]
    judged = body or own  # what tells a copy
    size = sum(len(lines[i]) for i in judged)
    templates = []
    for k, other in enumerate(neighbours):
        shared = shares[0] if k == 0 else shared_lines(lines, other)
        if sum(len(lines[i]) for i in judged if shared[i]) <= _COPY * size:
            templates.append(shared)
    gone = {i for i in own if templates and templates[0][i]}
    if body:
        if usual is None:
            gone -= {i for i in body if sum(shared[i] for shared in templates) < 2}
        else:
            gone -= {i for i in gone.intersection(body) if line_hash(lines[i]) not in usual}
    gone -= heads
    return [lines[i] for i in own if i not in gone], n_shared


def _prefix(a: str, b: str) -> int:
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return i
    return min(len(a), len(b))


# --- over a table ----------------------------------------------------------------


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars, n_lines, n_shared`` of every page.

    ``text`` are the lines of the main text joined by line feeds (empty if there are none or
    the page is NULL or empty), ``n_chars`` its code points, ``n_lines`` the lines of
    the whole page, ``n_shared`` those that the page nearest by URL has, too. NULL URLs are one
    host without a name. Other columns are ignored; an empty table gives an empty one.

    Pages are dealt out in order of host, path and key, in buckets by bounds from a
    sample, so that a hot host fills many of them. The first and last page of a bucket
    also go to the buckets beside it: every page meets its true neighbours, whatever
    the bounds. Each task reads its pages in order and holds three of them.

    An article's line is taken for a part of the template only if most pages of its host have it. A
    pass of its own counts the pages by host and line; only lines on most pages of a host are kept, and go
    to its pages.
    """
    place = pages.select(
        F.col(key).alias("key"), _host(text_or_empty(url)).alias("host"), _path(text_or_empty(url)).alias("path")
    )
    order = ["host", "path", "key"]
    buckets = min(max(place.count() // _PAGES_PER_BUCKET, 1), _MAX_BUCKETS)
    bounds = bucket_bounds(place, order, buckets)  # fewer where paths are very long

    def bucketed(df: DataFrame) -> DataFrame:
        return df.select("*", bucket_of(F.struct(*order), bounds).alias("bucket"))

    name = F.xxhash64(*order)
    edges = bucketed(place).groupBy("bucket").agg(
        F.min_by(name, F.struct(*order)).alias("first"), F.max_by(name, F.struct(*order)).alias("last")
    )
    by_bucket = Window.orderBy("bucket")  # over one row per bucket, 16,385 at most, as wide as two hashes
    beside = edges.select(
        F.col("first").alias("name"), F.lag("bucket").over(by_bucket).alias("beside")
    ).unionByName(edges.select(F.col("last").alias("name"), F.lead("bucket").over(by_bucket).alias("beside")))
    guests = beside.filter("beside is not null").groupBy("name").agg(F.collect_set("beside").alias("guests"))

    usual = scratch_table(_usual_lines(pages, url, html), "usual-lines")
    parsed = _parsed(pages, key, url, html)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))
    others = F.transform(
        F.coalesce("guests", F.array().cast("array<int>")),
        lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("guest")),
    )
    dealt = (
        bucketed(parsed.withColumn("host", _host(text_or_empty("url"))).withColumn("path", _path(text_or_empty("url"))))
        .withColumn("name", name)
        .join(F.broadcast(guests), "name", "left")  # two rows per bucket at most
        .join(usual, "host", "left")
        .withColumn("to", F.explode(F.concat(F.array(own), others)))
        .select("to.bucket", "to.guest", "key", "url", "host", "path", "lines", "marks", "usual")
        .repartition("bucket")
        .sortWithinPartitions("bucket", *order, "guest")
    )
    kind = pages.schema[key].dataType.simpleString()
    out = dealt.mapInPandas(
        _difference, f"key {kind}, url string, text string, n_chars long, n_lines long, n_shared long"
    )
    return out.withColumnsRenamed({"key": key, "url": url})


def _parsed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``key, url, lines, marks``: lines hold no line feeds, so one string has them all."""

    @F.pandas_udf("lines string, marks string")
    def parse(column: pd.Series) -> pd.DataFrame:
        parsed = [page_lines(x) for x in column]
        return pd.DataFrame({"lines": ["\n".join(x) for x, _ in parsed], "marks": [m for _, m in parsed]})

    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"), parse(F.col(html).cast("string")).alias("p")
    )
    return rows.select("key", "url", "p.lines", "p.marks")


def _usual_lines(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``host, usual``: the hashes of the article and main lines that most pages of a host have, if it has three."""

    @F.pandas_udf("array<long>")
    def own_lines(column: pd.Series) -> pd.Series:
        return pd.Series([sorted({line_hash(x) for x, m in zip(*page_lines(h)) if m in "am"}) for h in column])

    each = pages.select(_host(text_or_empty(url)).alias("host"), own_lines(F.col(html).cast("string")).alias("own"))
    # Counted before the shuffle: a line that a third of all pages have is one row per task.
    page = F.struct(F.lit(None).cast("long").alias("line"))
    rows = each.select("host", F.explode(F.concat(F.array(page), F.transform("own", lambda x: F.struct(x.alias("line"))))).alias("l"))
    counts = rows.groupBy("host", "l.line").agg(F.count("*").alias("n"))
    sizes = counts.filter("line is null and n >= 3").select("host", F.col("n").alias("pages"))
    # Lines that one page has cannot be on most; those of a hot host meet its size in many tasks.
    spread = F.explode(F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("part")
    part = F.pmod(F.col("line"), F.lit(_SPREAD)).cast("int").alias("part")
    more = counts.filter("line is not null and n >= 2").select("*", part)
    most = more.join(sizes.select("*", spread), ["host", "part"]).filter(F.col("n") * 2 > F.col("pages"))
    return most.groupBy("host").agg(F.collect_list("line").alias("usual"))  # few: twice a page's lines at most


def _difference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def pages():
        for batch in batches:
            yield from batch.to_dict("records")
        yield None

    def result(page: dict, before: dict | None, after: dict | None) -> tuple:
        lines = page["lines"].split("\n") if page["lines"] else []
        beside = [p for p in (before, after) if p and p["bucket"] == page["bucket"] and p["host"] == page["host"]]
        beside.sort(key=lambda p: -_prefix(p["path"], page["path"]))
        others = [p["lines"].split("\n") if p["lines"] else [] for p in beside]
        usual = page["usual"] if page["usual"] is not None else ()
        kept, shared = main_lines(lines, page["marks"], others, usual)
        text = "\n".join(kept)
        return page["key"], page["url"], text, len(text), len(lines), shared

    names = ["key", "url", "text", "n_chars", "n_lines", "n_shared"]
    before = page = None
    out: list[tuple] = []
    for after in pages():
        if page is not None and not page["guest"]:
            out.append(result(page, before, after))
        before, page = page, after
        if len(out) >= 500:
            yield pd.DataFrame(out, columns=names)
            out = []
    if out:
        yield pd.DataFrame(out, columns=names)
