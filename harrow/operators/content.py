"""Page content: title, visible text, heading and links from raw HTML.

All native expressions.  One pass removes comments/scripts/styles (lexical
blocks); a second removes noscript/svg/form elements.  The heading is read
after the first pass only (those elements still count for it), title, text and
links after the second.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.urls import normalise_url, parts, resolve_split, well_formed

ANCHOR = rf"(?i)<a\s{T.IN_TAG}>"
# The first attribute named href: others before it are stepped over whole.
HREF = (r"""(?is)^<a(?:\s+(?!href\s*=)[^\s=>]++(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+\s+href\s*=\s*"""
        r"""("[^"]*"|'[^']*'|[^\s"'>]+)""")


def hrefs(markup: Column) -> Column:
    anchors = F.regexp_extract_all(markup, F.lit(ANCHOR), 0)
    raw = F.filter(F.transform(anchors, lambda a: F.regexp_extract(a, HREF, 1)), lambda v: v != "")
    return F.transform(raw, lambda v: T.decode_entities(
        F.when(v.startswith('"') | v.startswith("'"), F.substring(v, 2, F.length(v) - 2)).otherwise(v)))


def all_links(markup: Column, base: Column) -> Column:
    """Resolved, normalised, distinct, code-point-sorted links of ``a[href]``, malformed ones too."""
    resolved = T.let(parts(base), lambda b: F.transform(hrefs(markup), lambda h: normalise_url(resolve_split(base, b, h))))
    return F.array_sort(F.array_distinct(resolved))


def heading(lexical: Column) -> Column:
    h1 = T.markup_text(T.element_inner(lexical, "h1"))
    h2 = T.markup_text(T.element_inner(lexical, "h2"))
    return F.when(h1 != "", h1).otherwise(h2)


def page_content(pages: DataFrame, with_links: bool = True) -> DataFrame:
    """``pages(url, html, ...)`` -> adds ``title, heading, text[, links, bad_link]``.

    Links that cannot be split as URLs are left out and noted in ``bad_link``.

    ``html`` is dropped so that everything downstream carries only the narrow
    derived columns.
    """
    staged = pages.withColumn("has_html", F.coalesce(F.length("html"), F.lit(0)) > 0) \
        .withColumn("_lex", T.strip_lexical(F.coalesce(F.col("html"), F.lit(""))))
    staged = staged.withColumn("_clean", T.strip_removed_elements(F.col("_lex")))
    exprs = T.cached_expr("page_content", lambda: {
        "title": T.title_text(T.element_inner(F.col("_clean"), "title")),
        "heading": heading(F.col("_lex")),
        "text": T.markup_text(F.col("_clean")),
        "links": all_links(F.col("_clean"), F.col("url")),
    })
    cols = ["title", "heading", "text"] + (["links"] if with_links else [])
    out = staged.select("*", *[exprs[c].alias(c) for c in cols])
    if with_links:
        out = out.withColumn("bad_link", F.exists("links", lambda u: ~well_formed(u))) \
            .withColumn("links", F.when(F.col("bad_link"), F.filter("links", well_formed)).otherwise(F.col("links")))
    return out.drop("_lex", "_clean", "html")
