"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: an element is known by its path of
tags, classes and ids.  For every path it is counted on how many of the host's
pages it stands (m), how often with which sequence of child elements (its
presentation styles) and with which texts.  With logarithms to the base m, a
path's presentation importance is the entropy of its styles, a text's
importance is 1 minus the entropy log_m(k) of a text that k pages share, and a
path's importance is the mean of both, texts weighted by their pages.  Branches
below ``IMPORTANCE`` and texts on at least ``m ** COMMON`` pages are removed
from each page, where the host has ``LEAST`` pages to judge by.

The tree says what a site repeats.  What a page itself declares is used too,
as an advert or a footer may be new on every page: menus, page headers,
footers, asides, forms, scripts, hidden elements, and elements whose class, id
or role names such a part are left out; if a page declares an article (or else
a main part), only that is read; of a page with both, the article if it is at
least half of the main part's text, else the main part.  If the tree would leave nothing of a page, or
less than half of a declared article, its declared content stands.

Counts are partial aggregates over (host, path, value) rows, so a host of any
size is spread out; a host's list of branches to remove is short, as each
stands on most of its pages.

Defined cases: null or empty html has the text ""; a null or odd url belongs
to the host ""; unclosed elements end with their parent, at the latest with the
page; repeated pages each get a row; an empty table gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from txrisk.llm.units import bounded_batches
from txrisk.session import fresh_path

IMPORTANCE = 0.1
COMMON = 0.9
COMMON_SHARE = 0.5  # of the pages of a host, at every size
LEAST = 8

# a quote opens a value only after "="; anywhere else it is a character like any other, and ">" ends the tag
TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?][^>]*>", re.S)
UNFINISHED = re.compile(r"<[/!a-zA-Z][^<>]*\Z")
ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes noscript iframe template svg canvas object annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr input button select math semantics mi mo mn ms mtext mrow mstyle mfrac msqrt mroot msub msup msubsup munder mover "
    "mfenced mspace".split()
)
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th".split())
DROPPED = frozenset("head nav aside form footer dialog menu button select datalist option audio video map".split()) | RAW
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table body html article main section div td th".split())
NOISE_WORD = frozenset(
    "ad ads adv advt adbox nav navbar side menu menus footer foot masthead topbar modal overlay alert alerts gdpr popup popups cookies toolbar "
    "pager share sharing social related recirc replies reply respond reactions discussion breadcrumb breadcrumbs login signup widget widgets".split()
)
# words that an article may also use for a part of its own ("related-work"): there they are noise only beside these
AMBIGUOUS = frozenset("side menu related social share sharing reply respond reactions discussion alert alerts foot login".split())
NEUTRAL = frozenset(
    "links link list lists box block bar buttons button icons icon posts post articles article stories story items item content container wrapper "
    "wrap section area news more reading topics media tools inner outer top bottom left right".split()
)
NOISE_START = (
    "advert", "sponsor", "promo", "banner", "sidebar", "comment", "cookie", "consent", "notice", "notif", "navig", "newsletter", "subscri",
    "recommend", "pagination", "disqus",
)
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text and not text.isspace() else {}


def declared_noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element says that it is not main content; ``inside`` an article or main part."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in NOISE_ROLE:
        return True
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = re.split(r"[^a-z0-9]+", name)
        for w in words:
            if w in AMBIGUOUS and inside and (tag in TEXT or not all(x in NOISE_WORD or x in NEUTRAL or x.isdigit() or not x for x in words)):
                continue
            if w in NOISE_WORD or w.startswith(NOISE_START) or (w == "header" and not inside):
                return True
    return False


class Page:
    """A page's text blocks: (path, text, declared noise, in an article, in a main part), and its elements' styles."""

    def __init__(self, html: str):
        self.blocks: list[tuple[int, str, bool, bool, bool, tuple[int, ...]]] = []
        self.styles: list[tuple[int, int]] = []
        self.stack: list[list] = [["", 0, False, False, False, [], False]]  # tag, path, noise, article, main, child tags, inline
        self.text: list[str] = []
        at = 0
        while True:
            m = TAG.search(html, at)
            if not m:
                break
            if m.start() > at:
                self.text.append(html[at : m.start()])
            at = m.end()
            if m[1] is None:
                continue
            tag = m[1].lower()
            if m[0][1] == "/":
                self._close(tag)
                continue
            closed = tag in VOID or m[2].rstrip().endswith("/") and tag in ("svg", "math")
            self._open(tag, m[2], closed)
            if tag in RAW and not closed:
                end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = end.start() if end else len(html)
        self.text.append(UNFINISHED.sub("", html[at:]))
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _flush(self) -> None:
        text = " ".join(unescape("".join(self.text)).split())
        self.text.clear()
        if text:
            top = self._block()
            self.blocks.append((top[1], text, top[2], top[3], top[4], tuple(x[1] for x in self.stack[1:] if not x[6])))

    def _block(self) -> list:
        for x in reversed(self.stack):
            if not x[6] or x[2]:
                return x
        return self.stack[0]

    def _open(self, tag: str, text: str, closed: bool) -> None:
        inline = tag in INLINE
        attrs = attributes(text)
        parent = self.stack[-1]
        noise = parent[2] or declared_noise(tag, attrs, parent[3] or parent[4])
        if not inline or noise != parent[2]:
            self._flush()
        if closed:
            return
        ends = CLOSES.get(tag, ())
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in ends or (self.stack[i][0] == "p" and not inline and tag != "p" and i == len(self.stack) - 1) or (tag == "p" and self.stack[i][0] == "p"):
                while len(self.stack) > i:
                    self._pop()
                break
            if self.stack[i][0] in SCOPES:
                break
        parent = self.stack[-1]
        noise = parent[2] or declared_noise(tag, attrs, parent[3] or parent[4])
        name = f"{tag}.{attrs.get('class', '')}#{attrs.get('id', '')}" if attrs else tag
        path = parent[1] if inline else xxh3_64_intdigest(f"{parent[1]}/{name}") >> 1
        if not inline:
            parent[5].append(name)
        main = parent[4] or tag == "main" or attrs.get("role") == "main"
        self.stack.append([tag, path, noise, parent[3] or tag == "article", main, [], inline])

    def _close(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                while len(self.stack) > i:
                    self._pop()
                return
        if tag in ("p", "br"):
            self._flush()

    def _pop(self) -> None:
        top = self.stack[-1]
        if not top[6] or top[2] != self.stack[-2][2]:
            self._flush()
        self.stack.pop()
        if not top[6]:
            # runs of the same element count once: the number of paragraphs is no style
            runs = [x for x, y in zip(top[5], ["", *top[5]], strict=False) if x != y]
            self.styles.append((top[1], xxh3_64_intdigest(">".join(runs)) >> 1))


def text_key(path: int, text: str) -> int:
    return xxh3_64_intdigest(f"{path}:{text}") >> 1


def main_text(html: str, removed: frozenset | set = frozenset()) -> str:
    """The main text of a page; ``removed``: keys of paths and of (path, text) of its host's low branches."""
    blocks = Page(html).blocks
    blocks = [b for b in blocks if not b[2]]
    part = next((k for k in (3, 4) if any(b[k] for b in blocks)), 0)
    if part == 3 and any(b[4] for b in blocks):  # both: the article is the main part's if it is most of it
        main = [b for b in blocks if b[4]]
        part = 3 if 2 * sum(len(b[1]) for b in main if b[3]) >= sum(len(b[1]) for b in main) else 4
        blocks = main
    if part:
        blocks = [b for b in blocks if b[part]]
    if removed:
        important = [b for b in blocks if removed.isdisjoint(b[5]) and text_key(b[0], b[1]) not in removed]
        size = sum(len(b[1]) for b in important)
        # if most of an article would go, the host's pages are copies of each other and the tree cannot judge
        if important and not (part and 2 * size < sum(len(b[1]) for b in blocks)):
            blocks = important
    return " ".join(b[1] for b in blocks)


def host(url: str = "url"):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?([^/?#:]*)", 1), F.lit(""))


def tree_rows(pages: DataFrame) -> DataFrame:
    """(host, kind, path, value), once a page: kind 0 a path, 1 a path's style, 2 a path's text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[tuple] = []
                for h, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(html)
                    own = {(0, p, 0) for p, _ in page.styles}
                    own |= {(1, p, s) for p, s in page.styles}
                    own |= {(2, b[0], text_key(b[0], b[1])) for b in page.blocks}
                    out += [(h, *x) for x in own]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["host", "kind", "path", "value"])

    types = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
    return pages.mapInArrow(run, "host string, kind int, path long, value long")


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, removed): the keys of each host's unimportant paths and texts."""
    m = tree.where("kind = 0").select("host", "path", F.col("pages").alias("m")).where(F.col("m") >= LEAST)
    share = tree.where("kind > 0").join(m, ["host", "path"])
    p, base = F.col("pages") / F.col("m"), F.log(F.col("m").cast("double"))
    spread = -F.sum(F.when(F.col("kind") == 1, p * F.log(p) / base).otherwise(0.0))
    news = F.sum(F.when(F.col("kind") == 2, F.col("pages") * (1 - F.log(F.col("pages").cast("double")) / base)))
    texts = F.sum(F.when(F.col("kind") == 2, F.col("pages")))
    paths = share.groupBy("host", "path").agg(spread.alias("style"), (news / texts).alias("text"))
    low = paths.where((F.col("style") + F.col("text")) / 2 < IMPORTANCE).select("host", F.col("path").alias("key"))
    common = share.where((F.col("kind") == 2) & (F.col("pages") >= F.greatest(F.pow("m", F.lit(COMMON)), COMMON_SHARE * F.col("m")))).select("host", F.col("value").alias("key"))
    return low.union(common).groupBy("host").agg(F.collect_list("key").alias("removed"))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    bounded_batches(spark)
    path = fresh_path(spark, "style-tree")
    tree_rows(pages.select("host", "html")).groupBy("host", "kind", "path", "value").agg(F.count("*").alias("pages")).write.parquet(path)
    low = fresh_path(spark, "low-branches")
    low_branches(spark.read.parquet(path)).write.parquet(low)
    removed = spark.read.parquet(low).select(F.col("host").alias("h"), "removed")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gone = [frozenset(x or ()) for x in part.column("removed").to_pylist()]
                texts = [main_text(html, r) for html, r in zip(part.column("html").to_pylist(), gone, strict=True)]
                chars = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), chars], ["page_id", "url", "text", "n_chars"])

    joined = pages.join(removed, F.col("host") == F.col("h"), "left").select("page_id", "url", "html", "removed")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
