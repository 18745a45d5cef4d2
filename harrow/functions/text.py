"""Column -> Column text helpers, all on the JVM side.

Whitespace follows the Unicode definition used by Python's ``str.strip`` and
``re``'s ``\\s`` so that trimming and collapsing agree with the behaviour being
reproduced; Spark's ``trim`` alone only removes U+0020.
"""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace, spelled out so Java and RE2 read it the same way.
WS = (r"[\t\n\x0B\x0C\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters, by their property: Java tests it at once, and the list one by one.
JAVA_WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
# Letters/digits/underscore, the word class used for whole-word tests.
WORD = r"[\p{L}\p{N}_]"

# Character-reference syntax (numeric, hex, or a run of name characters).
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\x0C <&#;]{1,32};?)"

# Removed with their content before any text is taken.  Comments, scripts and
# styles are lexical (their content is not markup), so they go first and in one
# leftmost-first pass; the element removals run on what is left.
LEXICAL_BLOCKS = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
REMOVED_ELEMENTS = ("noscript", "svg", "form")
# A tag ends at the first '>' outside of quoted attribute values.
IN_TAG = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
TAG = f"<[A-Za-z/!?]{IN_TAG}>"
REMOVED_TAG = f"(?i)</?(?:{'|'.join(REMOVED_ELEMENTS)})(?![A-Za-z0-9-]){IN_TAG}>"


_EXPRS: dict = {}


def cached_expr(key, build):
    """Build a (name-based, unresolved) Column once per SparkContext.

    Constructing large expressions costs many Python->JVM calls; the result
    only references columns by name, so it can be reused by every plan.
    """
    from pyspark import SparkContext

    sc = SparkContext._active_spark_context
    k = (sc.applicationId if sc is not None else None, key)
    if k not in _EXPRS:
        _EXPRS[k] = build()
    return _EXPRS[k]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it (possibly many times) in ``body``.

    Expression helpers reference their input several times; nesting them would
    otherwise copy the whole input subtree at every level.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def ustrip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(c, rf"^{JAVA_WS}+|{JAVA_WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Collapse every run of Unicode whitespace to one space and trim."""
    return F.trim(F.regexp_replace(c, rf"{JAVA_WS}+", " "))


def _named() -> tuple[Column, Column]:
    """The standard's named references: all, and those that need no ';', as literal maps.

    They come as one JSON literal each, which the optimizer folds into a map.
    """
    legacy = {k: v for k, v in html5.items() if not k.endswith(";")}
    return tuple(F.from_json(F.lit(json.dumps(m)), "map<string,string>") for m in (html5, legacy))


def _codepoint_char(cp: Column) -> Column:
    """Code point (int) -> text, by the standard's rules for numeric references.

    0x80-0x9F mean the Windows-1252 characters, where there is one; surrogates
    and numbers beyond Unicode give U+FFFD; controls and noncharacters nothing.
    """
    windows = [bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)]
    low = cp % 0x10000
    nothing = ((cp < 0x20) & ~cp.isin(9, 10, 12, 13)) | (cp == 0x7F) | ((cp >= 0xFDD0) & (cp <= 0xFDEF)) | (low >= 0xFFFE)
    bad = (cp <= 0) | (cp > 0x10FFFF) | ((cp >= 0xD800) & (cp <= 0xDFFF))
    ch = F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when((cp >= 0x80) & (cp <= 0x9F), F.get(F.array(*[F.lit(w) for w in windows]), cp - 0x80)) \
        .when(nothing, F.lit("")).otherwise(ch)


def _decode_reference(m: Column) -> Column:
    """Decode one matched character reference ``m`` (including the '&')."""
    common = F.when(m == "&amp;", F.lit("&")).when(m == "&quot;", F.lit('"')).when(m == "&nbsp;", F.lit("\u00a0")) \
        .when(m == "&lt;", F.lit("<")).when(m == "&gt;", F.lit(">"))
    return common.otherwise(let(F.regexp_replace(m, r"^&#[xX]?0*|;$", ""), lambda body: _decode_with_body(m, body)))


def _decode_with_body(m: Column, body: Column) -> Column:
    is_hex = m.rlike(r"^&#[xX]")
    is_dec = m.startswith("&#") & ~is_hex
    num = F.when(F.length(body) == 0, F.lit(0)).otherwise(
        F.when(is_hex & (F.length(body) <= 6), F.conv(body, 16, 10).cast("int"))
        .when(is_dec & (F.length(body) <= 7), body.cast("int"))
        .otherwise(F.lit(0x110000)))
    name = F.substring(m, 2, 64)
    exact, legacy = cached_expr("named references", _named)
    # A known name that needs no ';' may be run into by what follows: the longest such beginning.
    prefixed = F.lit(None).cast("string")
    for k in range(2, max(len(n) for n in html5 if not n.endswith(";")) + 1):
        hit = F.try_element_at(legacy, F.substring(name, 1, k))
        prefixed = F.when((F.length(name) > k) & hit.isNotNull(),
                          F.concat(hit, F.substring(name, k + 1, 64))).otherwise(prefixed)
    named = F.coalesce(F.try_element_at(exact, name), prefixed, m)
    return F.when(is_hex | is_dec, let(num, _codepoint_char)).otherwise(named)


def decode_entities(c: Column) -> Column:
    """Decode character references in one pass (``&amp;lt;`` -> ``&lt;``)."""
    return let(c, _decode_bound)


def _decode_bound(c: Column) -> Column:
    pieces = F.split(c, ENTITY, -1)
    refs = F.regexp_extract_all(c, F.lit(ENTITY), 0)
    decoded = F.transform(refs, _decode_reference)
    joined = F.array_join(F.zip_with(pieces, decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
    return F.when(c.contains("&"), joined).otherwise(c)


def strip_lexical(html: Column) -> Column:
    return F.regexp_replace(html, LEXICAL_BLOCKS, " ")


def strip_removed_elements(lexical: Column) -> Column:
    """Markup without the removed elements and all that is inside them.

    Their tags are read in order with the stack of those that are open: an end
    tag closes the innermost element of its name and what was opened in it, one
    without a beginning is dropped, and an element that never ends reaches to
    the end of the page.

    The fold copies little per tag.  The stack is its top letter with a number,
    and a text of the runs of equal letters below it, so any number of forms in
    forms is one run; what is kept is joined whenever ``KEPT_AT_ONCE`` parts have come.
    """
    return let(lexical, lambda m: F.when(m.rlike(REMOVED_TAG), _outside(m)).otherwise(m))


KEPT_AT_ONCE = 256
_DIGITS = 9


def _pushed(o: Column, name: Column) -> Column:
    below = F.when(o["top"] == "", F.lit("")).otherwise(F.concat(o["rest"], o["top"], F.lpad(o["n"].cast("string"), _DIGITS, "0")))
    same = o["top"] == name
    return F.struct(F.when(same, o["rest"]).otherwise(below).alias("rest"), name.alias("top"), F.when(same, o["n"] + 1).otherwise(F.lit(1)).alias("n"))


def _closed(o: Column, name: Column) -> Column:
    # What follows the last run of that letter: its number, and the runs that go with it.
    after = F.call_function("substring_index", o["rest"], name, F.lit(-1))
    found = F.struct(F.left(o["rest"], F.length(o["rest"]) - F.length(after) - 1).alias("rest"), name.alias("top"),
                     (F.left(after, F.lit(_DIGITS)).cast("int") - 1).alias("n"))
    one_less = F.struct(o["rest"].alias("rest"), o["top"].alias("top"), (o["n"] - 1).alias("n"))
    return let(F.when(o["top"] == name, one_less).when(o["rest"].contains(name), found).otherwise(_stack(o)), _uncovered)


def _stack(o: Column) -> Column:
    return F.struct(o["rest"].alias("rest"), o["top"].alias("top"), o["n"].alias("n"))


def _uncovered(o: Column) -> Column:
    """The stack, its top run taken from below where the last of the top run was closed."""
    size = F.length(o["rest"])
    below = F.struct(F.left(o["rest"], size - _DIGITS - 1).alias("rest"), F.substring(o["rest"], size - _DIGITS, F.lit(1)).alias("top"),
                     F.right(o["rest"], F.lit(_DIGITS)).cast("int").alias("n"))
    empty = F.struct(F.lit("").alias("rest"), F.lit("").alias("top"), F.lit(0).alias("n"))
    return F.when((o["n"] > 0) | (o["top"] == ""), o).when(o["rest"] == "", empty).otherwise(below)


def _outside(m: Column) -> Column:
    tags = F.regexp_extract_all(m, F.lit(REMOVED_TAG), 0)
    texts = F.split(m, REMOVED_TAG, -1)
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("rest"), F.lit("").alias("top"), F.lit(0).alias("n"), none.alias("done"), F.array(F.element_at(texts, 1)).alias("kept"))
    steps = F.zip_with(tags, F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))),
                       lambda t, x: F.struct(t.alias("tag"), x.alias("text")))

    def step(state, s):
        end, single = s["tag"].startswith("</"), s["tag"].endswith("/>")
        # The names begin with different letters.
        name = F.lower(F.substring(s["tag"], F.when(end, F.lit(3)).otherwise(F.lit(2)), F.lit(1)))
        now = let(name, lambda c: F.when(end, _closed(state, c)).when(single, _stack(state)).otherwise(_pushed(state, c)))

        def keep(o):
            out, full = o["top"] == "", F.size(state["kept"]) >= KEPT_AT_ONCE
            return F.struct(o["rest"].alias("rest"), o["top"].alias("top"), o["n"].alias("n"),
                            F.when(out & full, F.concat(state["done"], F.array(F.array_join(state["kept"], " ")))).otherwise(state["done"]).alias("done"),
                            F.when(out & full, F.array(s["text"])).when(out, F.concat(state["kept"], F.array(s["text"])))
                            .otherwise(state["kept"]).alias("kept"))
        return let(now, keep)

    def whole(state):
        return F.array_join(F.concat(state["done"], F.array(F.array_join(state["kept"], " "))), " ")
    return F.aggregate(steps, start, step, whole)


def markup_text(fragment: Column) -> Column:
    """Visible text of a markup fragment: tags -> space, decode, collapse."""
    return collapse_ws(decode_entities(F.regexp_replace(fragment, TAG, " ")))


def element_inner(markup: Column, tag: str) -> Column:
    """Inner markup of the first ``<tag>...</tag>`` ('' when absent)."""
    return F.regexp_extract(markup, rf"(?is)<{tag}(?![A-Za-z0-9-]){IN_TAG}>(.*?)</{tag}\s*>", 1)


def title_text(inner: Column) -> Column:
    """Strings of the title element, each stripped, joined by one space."""
    parts = F.transform(F.split(inner, TAG, -1), lambda s: ustrip(_decode_bound(s)))
    return F.array_join(F.filter(parts, lambda s: s != ""), " ")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of each letter run, lower-case the rest."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")


def strip_chars(c: Column, chars: str) -> Column:
    cls = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)
    return F.regexp_replace(c, f"^[{cls}]+|[{cls}]+$", "")


def contains_any(hay: Column, terms) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | hay.contains(t)
    return cond


def count_contained(hay: Column, terms) -> Column:
    total = F.lit(0)
    for t in terms:
        total = total + hay.contains(t).cast("int")
    return total


def hits(hay: Column, terms) -> Column:
    """Terms (in list order) that occur in ``hay`` as substrings."""
    if not terms:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(hay.contains(t), F.lit(t)) for t in terms]))


def is_missing(c: Column) -> Column:
    """Blank, NULL, or one of the missing tokens (trimmed, case-insensitive)."""
    from ..config import MISSING_TOKENS
    return let(F.lower(ustrip(c)), lambda v: F.coalesce((v == "") | v.isin(*MISSING_TOKENS), F.lit(True)))


def clipped(c: Column, chars: int | None) -> Column:
    """The first ``chars`` characters; all of them for None."""
    return c if chars is None else F.substring(c, 1, chars)
