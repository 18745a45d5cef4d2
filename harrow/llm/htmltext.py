"""Main text of web pages, with the templates of each site removed.

Every page is parsed into blocks of text.  Each block knows the hashes of the
element subtrees around it.  Two hashes are taken: of the subtree with its
texts, and, where most of its text is in links (menus), of its shape alone.
Spark counts on how many pages of a host each hash occurs; blocks inside subtrees
that recur across many pages of their host are deleted.
What marks itself as furniture by its tag, role, class or id goes as well, as on
hosts with few pages nothing can recur; class and id don't count on the page, the
main element and articles, nor where they would take all articles of a page, and inside an article
only where the whole name says furniture, not on headings and paragraphs.  An article in an article that is named
a comment goes, and so do forms, unless all text of the page, or all its articles, is in them.  Of the blocks left, those in an article
are the text; without an article those in the main element; else all.

Inside an article, subtrees count by their texts, not by their shape, as lists
of sources look alike: those with most of their text in links, and the
containers (``CONTAINERS``) that hold at most half of the article and lie in no quote.
The latter are counted over different articles of the host, so that copies of
a page are no templates.  Paragraphs, lists and quotes that an article itself
holds belong to it, however many articles share them.

Defined cases: a null or empty html gives the empty text; unclosed elements end
where an enclosing one ends, or where HTML implies their end; a comment or
script that is never closed runs to the end of the page; a page with a null url
belongs to the host "" like all other such pages; repeated rows are pages of
their own.
"""
from __future__ import annotations

import re
import zlib
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

# The elements of HTML by what they mean here.
RAW = frozenset("script style noscript template svg math iframe textarea select option object canvas audio video title".split())
FURNITURE = frozenset("head nav footer aside button menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section "
                    "summary table tbody td tfoot th thead tr ul").split())
ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
        "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
WORDS = frozenset(("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
                   "navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices "
                   "newsletter subscribe signup popup modal overlay comment comments commentlist disqus respond reply replies related "
                   "recommended recommendations share sharing social toolbar pagination pager login search widget skip topbar").split())
OUTSIDE_WORDS = frozenset(("header", "head"))
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond".split())
# Inside an article a name counts if all of it is made of the words above and of these, which say what form a thing has.
FORM_WORDS = frozenset("area bar block body box btn button buttons container content form icons inner item items left links list "
                       "main outer post posts right row section thread unit wrap wrapper".split())
# These are named after their text, for links to them.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
# Elements inside an article that only hold others: those that recur are the site's, what they stand beside is the article's.
CONTAINERS = frozenset("div section center details fieldset header address".split())
QUOTES = frozenset("blockquote pre figure".split())
# Tells counts over different articles from those over pages.
INSIDE = 0x5DEECE66D
# With one of these in it, a class or id tells about a part or a state of the element, not what it is.
ABOUT = frozenset("has have with without no not is hide hides show shows open closed enabled disabled on off".split())
WHOLE = frozenset("html body main article".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>"""
                   r"""|<([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


def attributes(source: str) -> dict[str, str]:
    if not source.strip():
        return {}
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(ATTRIBUTE.findall(source))}


def furniture(tag: str, at: dict[str, str], inside: bool) -> bool:
    """Whether an element is no text by its tag, role or state."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if not at:
        return False
    if "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in at.get("style", "").replace(" ", "").lower():
        return True
    return at.get("role", "").lower() in ROLES


def named(tag: str, at: dict[str, str], inside: bool, article: bool = False) -> bool:
    """Whether an element calls itself furniture by its class or id; never the page, its main element or an article.

    Inside an article (``article``) only names that say nothing else count, as ``related-work`` is no list of related pages,
    and never those of headings and paragraphs; an article in an article can be a comment.
    """
    if tag == "form":
        return True
    if not at or at.get("role") == "main" or tag in WHOLE and not (tag == "article" and article):
        return False
    if article and tag in TEXTUAL:
        return False
    for name in f"{at.get('class', '')} {at.get('id', '')}".lower().split():
        words = set(re.split(r"[^a-z0-9]+", name)) - {""}
        if words & ABOUT:
            continue
        if tag == "article":
            if words & COMMENT_WORDS and words <= COMMENT_WORDS | FORM_WORDS:
                return True
        elif article:
            if words & WORDS and all(w in WORDS or w in FORM_WORDS or w.isdigit() for w in words):
                return True
        elif words & WORDS or not inside and words & OUTSIDE_WORDS:
            return True
    return False


class Element:
    __slots__ = ("article", "articles", "chars", "furniture", "key", "linked", "main", "named", "quote", "shape", "sign", "tag", "up")

    def __init__(self, tag: str, up: Element | None, at: dict[str, str]):
        self.tag, self.up = tag, up
        self.article = up is not None and up.article or tag == "article"
        self.main = up is not None and up.main or tag == "main" or at.get("role") == "main"
        inside = up is not None and (up.article or up.main)
        self.furniture = up is not None and up.furniture or furniture(tag, at, inside)
        self.named = named(tag, at, inside, up is not None and up.article)
        self.quote = up is not None and up.quote or tag in QUOTES
        self.articles = 0
        if tag == "article" and not up.article and not self.furniture:
            while up is not None:
                up.articles += 1
                up = up.up
        self.sign = f"<{tag}|{at.get('class', '')}|{at.get('id', '')}"
        self.key = self.shape = 0
        self.chars = self.linked = 0

    def add(self, sign: str, shape: str) -> None:
        self.key = zlib.crc32(sign.encode("utf-8", "surrogatepass"), self.key) | (zlib.adler32(sign.encode("utf-8", "surrogatepass"), self.key >> 32 or 1) << 32)
        if shape:
            self.shape = zlib.crc32(shape.encode(), self.shape)


def held(e: Element) -> bool:
    """Whether ``e`` is a container in an article, with text of its own and at most half of the article's; all are closed."""
    if not e.up.article or e.tag not in CONTAINERS or e.quote or not e.chars or e.linked * 2 > e.chars:
        return False
    whole = e.up
    while whole.up.article:
        whole = whole.up
    return e.chars * 2 <= whole.chars


def blocks(html: str) -> tuple[list[tuple[str, int, bool, list[int]]], list[int], list[int]]:
    """Blocks of a page, as ``(text, rank, furniture, subtree hashes)``, all subtree hashes, and those of containers inside articles.

    ``rank`` is 2 in an article, 1 in the main element, 0 elsewhere.
    """
    top = Element("#", None, {})
    now, out, pending, anchors = top, [], [], 0
    marks: set[int] = set()
    containers: list[Element] = []

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            out.append((text, now))

    def close(e: Element) -> Element:
        """Ends an element: its hashes are complete and count for its parent."""
        up = e.up
        if e.article:
            if up.article:
                e.add(e.sign, "")
                e.key &= (1 << 63) - 1
                if e.tag in BLOCKS and e.linked * 2 > e.chars:
                    marks.add(e.key)
                elif e.tag in CONTAINERS:
                    containers.append(e)
                up.add(f"{e.key:x}", "")
                up.chars += e.chars
                up.linked += e.linked
        else:
            e.shape = zlib.crc32(e.sign.encode("utf-8", "surrogatepass"), e.shape)
            e.add(e.sign, "")
            e.key &= (1 << 63) - 1
            if e.chars and e.tag in BLOCKS and e.tag not in ("html", "body"):
                marks.add(e.key)
                if e.linked * 2 > e.chars:
                    marks.add(-e.shape - 1)
            up.add(f"{e.key:x}", "")
            # A run of equal children counts once, so menus of different lengths agree.
            up.shape ^= zlib.crc32(f"{e.tag}:{e.shape:x}".encode()) if (up.shape & 0xFFFF) != (e.shape & 0xFFFF) else 0
            up.chars += e.chars
            up.linked += e.linked
        return up

    def end(tags, stop=()) -> bool:
        """Closes up to the innermost open element of ``tags``, unless one of ``stop`` is nearer."""
        nonlocal now
        e = now
        while e is not top and e.tag not in tags:
            if e.tag in stop:
                return False
            e = e.up
        if e is top:
            return False
        flush()
        while now is not e:
            now = close(now)
        now = close(now)
        return True

    def text(s: str) -> None:
        if not s:
            return
        s = unescape(s) if "&" in s else s
        pending.append(s)
        if t := s.strip():
            now.add(t, "")
            now.chars += len(t)
            if anchors:
                now.linked += len(t)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in BLOCKS:
                flush()
            if tag == "a" and anchors:
                anchors -= 1
            if tag in BLOCKS or tag == "a":
                end((tag,), ("article", "table") if tag in ("p", "li", "a") else ())
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                pending.append(" ")
            if tag in VOID:
                if tag in BLOCKS:
                    flush()
                continue
            if tag in RAW:
                if not m[3].rstrip().endswith("/"):
                    stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                    at = stop.end() if stop else n
                continue
            if tag in BLOCKS:
                flush()
                if tag in ENDS:
                    end(ENDS[tag][0].split(), ENDS[tag][1].split())
                end(("p",), ("article", "table", "td", "div", "li", "blockquote", "section"))
                now = Element(tag, now, attributes(m[3]))
            elif tag == "a":
                anchors += 1
                now = Element(tag, now, {})
            elif m[3].strip() and (furniture(tag, attributes(m[3]), now.article or now.main) or named(tag, attributes(m[3]), now.article or now.main, now.article)):
                now = Element(tag, now, attributes(m[3]))
            elif tag == "span" and now.tag == "span":
                now = Element(tag, now, {})
    flush()
    while now is not top:
        now = close(now)
    inner = {e.key ^ INSIDE for e in containers if held(e)}

    def called(e: Element, least: int) -> bool:
        """Whether ``e`` lies in an element named as furniture that holds fewer than ``least`` articles."""
        while e is not top:
            if e.named and e.articles < least:
                return True
            e = e.up
        return False

    # A name doesn't take away all articles of a page.
    least = max(1, top.articles)
    if top.articles > 1 and not any(e.article and not e.furniture and not called(e, least) for _, e in out):
        least = 1
    # Nor does a form that the whole page is in.
    forms = bool(out) and all(e.furniture or called(e, least) for _, e in out)
    if forms:
        for _, e in out:
            while e is not top:
                e.named &= e.tag != "form"
                e = e.up
    rows = []
    for t, e in out:
        rank, role, chain = 2 if e.article else 1 if e.main else 0, e.furniture or called(e, least), []
        while e.article:
            if e.up.article and e.tag in BLOCKS and e.linked * 2 > e.chars:
                chain.append(e.key)
            elif held(e):
                chain.append(e.key ^ INSIDE)
            e = e.up
        while e is not top and rank < 2:
            if e.tag in BLOCKS and e.tag not in ("html", "body"):
                chain += [e.key, -e.shape - 1] if e.linked * 2 > e.chars else [e.key]
            e = e.up
        rows.append((t, rank, role, chain))
    return rows, sorted(marks), sorted(inner)


PARSED = "array<struct<text:string,rank:int,chain:array<long>>>"


def _parse(column: str, with_text: bool):
    """``text`` where an article decides it, as no template can be in it; else the blocks that may be text.

    With ``with_text`` nothing but the text.
    """
    kind = "string" if with_text else f"struct<decided:boolean,blocks:{PARSED},marks:array<long>,containers:array<long>,article:long>"

    def article(rows):
        """Text blocks of the articles, none where one lies in a subtree that may be a template."""
        own = [(t, chain) for t, rank, role, chain in rows if rank == 2 and not role]
        return [] if any(chain for _, chain in own) else [t for t, _ in own]

    @F.pandas_udf(kind)
    def text(html: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(article(blocks(h)[0])) for h in html], dtype=object)

    @F.pandas_udf(kind)
    def tree(html: pd.Series) -> pd.DataFrame:
        decided, left, marks, containers, whole = [], [], [], [], []
        for h in html:
            rows, m, inner = blocks(h)
            known = bool(article(rows))
            decided.append(known)
            left.append([] if known else [(t, rank, chain) for t, rank, role, chain in rows if not role])
            marks.append(m)
            containers.append(inner)
            own = "\n".join(t for t, rank, _, _ in rows if rank == 2).encode("utf-8", "surrogatepass")
            whole.append(zlib.crc32(own) << 31 ^ zlib.adler32(own))
        return pd.DataFrame({"decided": decided, "blocks": left, "marks": marks, "containers": containers, "article": whole})

    return (text if with_text else tree)(F.col(column))


def main_text(pages: DataFrame, min_pages: int = 5, share: float = 0.05) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A subtree is a template when it occurs on at least ``min_pages`` pages and
    a ``share`` of the pages of its host.
    """
    host = F.lower(F.regexp_extract(text_of("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", text_of("html").alias("html"))
    # Pages are parsed twice, as that moves less than a copy of all texts would.
    tree = staged(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("host", host)
                  .select("row", "page_id", "url", "host", _parse("html", False).alias("p"))
                  .select("row", "page_id", "url", "host", "p.*"), "trees")
    # A container inside an article counts once for all copies of the article.
    inner = tree.select("host", "article", F.explode("containers").alias("mark")).distinct()
    often = tree.select("host", F.explode("marks").alias("mark")).unionByName(inner.drop("article")) \
        .groupBy("host", "mark").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages) \
        .join(tree.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host").filter(F.col("n") >= share * F.col("pages")) \
        .select("host", "mark")
    open_ = tree.filter("not decided").select("row", "page_id", "url", "host", "blocks")
    inside = open_.select("row", "host", F.explode(F.array_distinct(F.flatten("blocks.chain"))).alias("mark"))
    gone = inside.join(often, ["host", "mark"]).groupBy("row").agg(F.collect_set("mark").alias("gone"))
    left = F.filter("blocks", lambda b: ~F.arrays_overlap(b["chain"], F.coalesce("gone", F.array().cast("array<long>"))))
    best = F.array_max(F.transform("left", lambda b: b["rank"]))
    text = F.array_join(F.transform(F.filter("left", lambda b: b["rank"] == F.col("best")), lambda b: b["text"]), "\n")
    others = open_.join(gone, "row", "left").withColumn("left", left).withColumn("best", best) \
        .select("page_id", "url", F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("page_id", "url", _parse("html", True).alias("text")).filter("text <> ''").unionByName(others) \
        .withColumn("n_chars", F.length("text").cast("long"))
