"""DuckDB SQL for the correctness oracle.

Each builder returns SQL text for DuckDB over the driver's pre-registered
views.  The rules are the same as the Spark side's, restated in DuckDB's
dialect with expressions of their own (RE2 without look-around, ``lambda`` list
functions), so a mistake in an expression of one side shows.
"""
from __future__ import annotations

import html.entities
import itertools
import json
import urllib.parse

from .. import config as C

# Written for DuckDB's expressions, apart from those that Spark's side uses.
WS = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in map(chr, range(0x3001)) if c.isspace()) + "]"
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)"
INSIDE = "(?:[^>=]|=\\s*\"[^\"]*\"|=\\s*'[^']*'|=)*"
MARKUP = f"<[a-zA-Z/!?]{INSIDE}>"
SCRIPTS = "(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
BOXES = f"(?i)</?(?:noscript|svg|form)(?:[^a-zA-Z0-9>-]{INSIDE})?>"
ANCHORS = f"(?i)<a\\s{INSIDE}>"
ATTRIBUTES = "\\s([^\\s=>]+)(?:\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s>]*))?"
# Scheme, authority, path, query and fragment of a URL (RFC 3986, appendix B).
SPLIT = "^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^?/#]*))?([^#?]*)(?:\\?([^#]*))?(?:#(.*))?$"
LAST_PARAMS = "^((?:.*/)?[^;/]*);$"
WITH_AUTHORITY = sorted(x for x in urllib.parse.uses_netloc if x)
WITH_PARAMS = sorted(urllib.parse.uses_params)

_ids = itertools.count()


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def v() -> str:
    return f"v{next(_ids)}"


def let(e: str, body) -> str:
    x = v()
    return f"list_transform([{e}], lambda {x}: {body(x)})[1]"


def ustrip(e: str) -> str:
    return f"regexp_replace({e}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, {q(f'{WS}+')}, ' ', 'g'))"


def _decode_ref(m: str) -> str:
    names = html.entities.html5
    everything = f"CAST({q(json.dumps(names))}::JSON AS MAP(VARCHAR, VARCHAR))"
    legacy = "[" + ", ".join(q(n) for n in names if not n.endswith(";")) + "]"
    windows = "[" + ", ".join(f"chr({ord(bytes([n]).decode('cp1252', 'ignore') or chr(n))})" for n in range(128, 160)) + "]"

    def with_body(b):
        is_hex = f"regexp_matches({m}, '^&#[xX]')"
        is_dec = f"(starts_with({m}, '&#') AND NOT {is_hex})"
        num = (f"(CASE WHEN length({b}) = 0 THEN 0 WHEN {is_hex} AND length({b}) <= 6 THEN ('0x' || {b})::INTEGER "
               f"WHEN {is_dec} AND length({b}) <= 7 THEN {b}::INTEGER ELSE 1114112 END)")
        ch = let(num, lambda n: (
            f"CASE WHEN {n} = 0 OR {n} > 1114111 OR {n} BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN {n} BETWEEN 128 AND 159 THEN {windows}[{n} - 127] "
            f"WHEN {n} BETWEEN 1 AND 8 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} = 127 OR {n} BETWEEN 64976 AND 65007 "
            f"OR {n} & 65534 = 65534 THEN '' ELSE chr({n}) END"))
        name = f"substring({m}, 2, 64)"
        k = v()
        longest = let(f"list_max(list_filter(range(2, least(length({name}), 7)), lambda {k}: "
                      f"list_contains({legacy}, substring({name}, 1, {k}))))",
                      lambda x: f"CASE WHEN {x} IS NULL THEN {m} ELSE {everything}[substring({name}, 1, {x})] || substring({name}, {x} + 1, 64) END")
        return f"CASE WHEN {is_hex} OR {is_dec} THEN {ch} ELSE coalesce({everything}[{name}], {longest}) END"

    digits = let(f"regexp_replace({m}, '^&#[xX]?0*|;$', '', 'g')", with_body)
    return f"CASE {m} WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '\"' ELSE {digits} END"


def decode(e: str) -> str:
    def body(c):
        parts = f"regexp_split_to_array({c}, {q(REFERENCE)})"
        m = v()
        refs = f"list_transform(regexp_extract_all({c}, {q(REFERENCE)}, 0), lambda {m}: {_decode_ref(m)})"
        i = v()
        joined = let(parts, lambda p: let(refs, lambda d: (
            f"array_to_string(list_transform(range(1, len({p}) + 1), lambda {i}: {p}[{i}] || coalesce({d}[{i}], '')), '')")))
        return f"CASE WHEN strpos({c}, '&') > 0 THEN {joined} ELSE {c} END"
    return let(e, body)


def markup_text(e: str) -> str:
    return collapse(decode(f"regexp_replace({e}, {q(MARKUP)}, ' ', 'g')"))


def inner(e: str, tag: str) -> str:
    return f"regexp_extract({e}, {q(f'(?is)<{tag}(?:[^a-zA-Z0-9>-]{INSIDE})?>(.*?)</{tag}\\s*>')}, 1)"


def title_text(e: str) -> str:
    s = v()
    t = v()
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({e}, {q(MARKUP)}), lambda {s}: "
            f"{ustrip(decode(s))}), lambda {t}: {t} <> ''), ' ')")


def lexical(html: str) -> str:
    return f"regexp_replace(coalesce({html}, ''), {q(SCRIPTS)}, ' ', 'g')"


def cleaned(lex: str) -> str:
    """Markup outside of noscript, svg and form, by a walk over their tags with the list of open ones."""
    def walk(m):
        tags, texts, state, i, x = v(), v(), v(), v(), v()

        def step(tag):
            name = f"lower(regexp_extract({tag}, '^</?([a-zA-Z]+)', 1))"
            at = f"(len({state}.o) - list_position(list_reverse({state}.o), {name}) + 1)"
            stack = (f"CASE WHEN starts_with({tag}, '</') THEN CASE WHEN list_contains({state}.o, {name}) THEN {state}.o[1:{at} - 1] "
                     f"ELSE {state}.o END WHEN ends_with({tag}, '/>') THEN {state}.o ELSE list_append({state}.o, {name}) END")
            return let(stack, lambda o: (f"struct_pack(o := {o}, kept := CASE WHEN len({o}) = 0 THEN list_append({state}.kept, {texts}[{i}.n + 1]) "
                                         f"ELSE {state}.kept END, n := 0)"))
        first = f"struct_pack(o := []::VARCHAR[], kept := [{texts}[1]], n := 0)"
        steps = (f"list_prepend({first}, list_transform(range(1, len({tags}) + 1), lambda {x}: "
                 f"struct_pack(o := []::VARCHAR[], kept := []::VARCHAR[], n := {x}::INTEGER)))")
        fold = f"list_reduce({steps}, lambda {state}, {i}: {let(f'{tags}[{i}.n]', step)})"
        return (f"list_transform([regexp_extract_all({m}, {q(BOXES)}, 0)], lambda {tags}: "
                f"list_transform([regexp_split_to_array({m}, {q(BOXES)})], lambda {texts}: array_to_string(({fold}).kept, ' '))[1])[1]")
    return let(lex, lambda m: f"CASE WHEN regexp_matches({m}, {q(BOXES)}) THEN {walk(m)} ELSE {m} END")


def heading(lex: str) -> str:
    return let(markup_text(inner(lex, "h1")), lambda h1: f"CASE WHEN {h1} <> '' THEN {h1} ELSE {markup_text(inner(lex, 'h2'))} END")


# -- URLs ------------------------------------------------------------------
def part(u: str, i: int) -> str:
    return f"regexp_extract({u}, {q(SPLIT)}, {i})"


def scheme(u: str) -> str:
    return f"lower({part(u, 1)})"


def host(u: str) -> str:
    return let(f"regexp_replace({part(u, 2)}, '^.*@', '')", lambda info: (
        f"lower(CASE WHEN strpos({info}, '[') > 0 THEN regexp_extract({info}, '\\[([^\\]]*)', 1) "
        f"ELSE split_part({info}, ':', 1) END)"))


def assemble(sch: str, net: str, pth: str, qry: str) -> str:
    schemes = ", ".join(q(s) for s in WITH_AUTHORITY)
    body = (f"(CASE WHEN {net} <> '' THEN '//' || {net} || (CASE WHEN {pth} <> '' AND NOT starts_with({pth}, '/') "
            f"THEN '/' || {pth} ELSE {pth} END) WHEN starts_with({pth}, '//') THEN '//' || {pth} "
            f"WHEN {sch} IN ({schemes}) AND ({pth} = '' OR starts_with({pth}, '/')) THEN '//' || {pth} ELSE {pth} END)")
    return (f"((CASE WHEN {sch} <> '' THEN {sch} || ':' ELSE '' END) || {body} || "
            f"(CASE WHEN {qry} <> '' THEN '?' || {qry} ELSE '' END))")


def parts(u: str):
    return f"struct_pack(s := {scheme(u)}, n := {part(u, 2)}, p := {part(u, 3)}, q := {part(u, 4)})"


def normalise_url(u: str) -> str:
    cleaned_ = f"regexp_replace({ustrip(u)}, '[\\t\\r\\n]', '', 'g')"
    ws = let(cleaned_, lambda s: f"CASE WHEN regexp_matches({s}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {s} ELSE 'https://' || {s} END")
    pschemes = ", ".join(q(x) for x in WITH_PARAMS)

    def reasm(x):
        p = (f"(CASE WHEN {x}.s IN ({pschemes}) THEN regexp_replace({x}.p, {q(LAST_PARAMS)}, '\\1') "
             f"ELSE {x}.p END)")
        return assemble(f"{x}.s", f"{x}.n", p, f"{x}.q")
    asm = let(ws, lambda s: let(parts(s), reasm))
    return f"regexp_replace({asm}, '/+$', '', 'g')"


def normalise_domain(e: str) -> str:
    def body(val):
        as_url = f"(CASE WHEN strpos({val}, '://') > 0 THEN {val} ELSE 'https://' || {val} END)"
        return let(host(as_url), lambda h: f"regexp_replace(CASE WHEN {h} <> '' THEN {h} ELSE {val} END, '^www\\.', '', 'g')")
    return let(f"lower({ustrip(e)})", body)


def is_allowed(u: str, d: str) -> str:
    """``d`` is a normalised domain."""
    return let(f"regexp_replace({host(u)}, '^www\\.', '', 'g')", lambda h: (
        f"({scheme(u)} IN ('http', 'https') AND ({h} = {d} OR ends_with({h}, '.' || {d})))"))


def should_skip(u: str, cfg: C.MiningConfig) -> str:
    def body(low):
        conds = [f"starts_with({low}, {q(s)})" for s in cfg.skip_schemes]
        conds += [f"ends_with({low}, {q(e)})" for e in cfg.negative_extensions]
        conds += [f"contains({low}, {q(p)})" for p in cfg.avoid_url_parts]
        return "(" + " OR ".join(conds) + ")"
    return let(f"lower({u})", body)


def should_enqueue(u: str, d: str, cfg: C.MiningConfig) -> str:
    def body(low):
        hinted = " OR ".join(f"contains({low}, {q(h)})" for h in cfg.url_hints) or "FALSE"
        slashes = f"(length({low}) - length(replace({low}, '/', '')))"
        return f"(({hinted}) OR {slashes} <= {C.MAX_PATH_SLASHES})"
    return f"(NOT {should_skip(u, cfg)} AND {let(f'lower({u})', body)} AND {is_allowed(u, d)})"


def _dot_segments(segs: str) -> str:
    def with_segs2(s2):
        acc, s = v(), v()
        red = (f"list_reduce({s2}, lambda {acc}, {s}: CASE WHEN {s} = '..' THEN (CASE WHEN len({acc}) > 0 THEN "
               f"{acc}[1:len({acc}) - 1] ELSE {acc} END) WHEN {s} = '.' THEN {acc} ELSE list_append({acc}, {s}) END, "
               f"[]::VARCHAR[])")
        fixed = let(red, lambda r: f"CASE WHEN {s2}[len({s2})] IN ('.', '..') THEN list_append({r}, '') ELSE {r} END")
        return let(f"array_to_string({fixed}, '/')", lambda p: f"CASE WHEN {p} = '' THEN '/' ELSE {p} END")
    return let(segs, with_segs2)


def _drop_empty_middle(segs: str) -> str:
    def body(sg):
        x = v()
        middle = f"list_filter({sg}[2:len({sg}) - 1], lambda {x}: {x} <> '')"
        return f"CASE WHEN len({sg}) >= 2 THEN list_concat([{sg}[1]], {middle}, [{sg}[len({sg})]]) ELSE {sg} END"
    return let(segs, body)


def resolve(base: str, href: str) -> str:
    h0 = f"regexp_replace(regexp_replace({href}, '[\\t\\r\\n]', '', 'g'), '^[\\x00-\\x20]+', '', 'g')"

    def with_h(h):
        def with_b(b):
            bs, bn, bp, bq = f"{b}.s", f"{b}.n", f"{b}.p", f"{b}.q"
            hs = f"lower(regexp_extract({h}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"

            def with_hs(hsv):
                rest = (f"CASE WHEN {hsv} <> '' AND {hsv} = {bs} THEN regexp_replace({h}, '^[A-Za-z][A-Za-z0-9+.-]*:', '', 'g') "
                        f"ELSE {h} END")

                def with_rest(r):
                    rn = f"regexp_extract({r}, '^//([^/?#]*)', 1)"
                    no_auth = f"regexp_replace({r}, '^//[^/?#]*', '', 'g')"
                    rp = f"regexp_replace(regexp_extract({no_auth}, '^([^?#]*)', 1), {q(LAST_PARAMS)}, '\\1')"
                    rq = f"regexp_extract({no_auth}, '^[^?#]*\\?([^#]*)', 1)"

                    def merge(x):
                        n_, p_, q_ = f"{x}.n", f"{x}.p", f"{x}.q"
                        base_dir = let(f"string_split({bp}, '/')", lambda d: (
                            f"CASE WHEN {d}[len({d})] <> '' THEN {d}[1:len({d}) - 1] ELSE {d} END"))
                        segs = (f"CASE WHEN starts_with({p_}, '/') THEN string_split({p_}, '/') "
                                f"ELSE {_drop_empty_middle(f'list_concat({base_dir}, string_split({p_}, {q(chr(47))}))')} END")
                        return (f"CASE WHEN {h} = '' THEN {base} "
                                f"WHEN {hsv} <> '' AND {hsv} <> {bs} THEN {h} "
                                f"WHEN {n_} <> '' THEN {assemble(bs, n_, p_, q_)} "
                                f"WHEN {p_} = '' THEN {assemble(bs, bn, bp, f"(CASE WHEN {q_} <> '' THEN {q_} ELSE {bq} END)")} "
                                f"ELSE {assemble(bs, bn, _dot_segments(segs), q_)} END")
                    return let(f"struct_pack(n := {rn}, p := {rp}, q := {rq})", merge)
                return let(rest, with_rest)
            return let(hs, with_hs)
        return let(parts(base), with_b)
    return let(h0, with_h)


def hrefs(markup: str) -> str:
    a, x, n, z = v(), v(), v(), v()
    names = f"regexp_extract_all({a}, {q(ATTRIBUTES)}, 1)"
    values = f"regexp_extract_all({a}, {q(ATTRIBUTES)}, 2)"
    at = f"list_position(list_transform({names}, lambda {n}: lower({n})), 'href')"
    found = f"list_transform(regexp_extract_all({markup}, {q(ANCHORS)}, 0), lambda {a}: {values}[{at}])"
    unq = (f"CASE WHEN starts_with({x}, '\"') OR starts_with({x}, '''') THEN substring({x}, 2, length({x}) - 2) "
           f"ELSE {x} END")
    return f"list_transform(list_filter({found}, lambda {z}: {z} <> ''), lambda {x}: {decode(unq)})"


def links(markup: str, base: str) -> str:
    h = v()
    return f"list_sort(list_distinct(list_transform({hrefs(markup)}, lambda {h}: {normalise_url(resolve(base, h))})))"


def path_tail(u: str) -> str:
    p = f"regexp_replace(regexp_replace({part(u, 3)}, ';[^/]*$', '', 'g'), '/+$', '', 'g')"
    return let(p, lambda x: f"(string_split({x}, '/'))[len(string_split({x}, '/'))]")


def block_path(u: str) -> str:
    return f"regexp_replace(regexp_replace({part(u, 3)}, ';[^/]*$', '', 'g'), '/+$', '', 'g')"


def host_suffix_match(h: str, d: str) -> str:
    return f"({h} = {d} OR ends_with({h}, '.' || {d}))"


# -- text rules ------------------------------------------------------------
def contains_count(hay: str, terms) -> str:
    if not terms:
        return "0"
    return "(" + " + ".join(f"(CASE WHEN contains({hay}, {q(t)}) THEN 1 ELSE 0 END)" for t in terms) + ")"


def contains_any(hay: str, terms) -> str:
    if not terms:
        return "FALSE"
    return "(" + " OR ".join(f"contains({hay}, {q(t)})" for t in terms) + ")"


def hits(hay: str, terms) -> str:
    if not terms:
        return "[]::VARCHAR[]"
    k = v()
    return f"list_filter([{', '.join(q(t) for t in terms)}], lambda {k}: contains({hay}, {k}))"


def score_cols(title: str, url: str, text: str, cfg: C.MiningConfig) -> str:
    """SELECT-list fragment: candidate_score, matched_keywords(list), candidate_type, reason."""
    hay = f"lower(concat_ws(' ', coalesce({title}, ''), {url}, {clipped(f"coalesce({text}, '')", cfg.score_text_chars)}))"
    def body(h):
        lurl = f"lower({url})"
        nh, nl, nu = contains_count(h, cfg.high_keywords), contains_count(h, cfg.low_keywords), contains_count(lurl, cfg.url_hints)
        base = f"least(100, {nh} * {C.HIGH_WEIGHT} + {nl} * {C.LOW_WEIGHT} + {nu} * {C.URL_WEIGHT})"
        score = f"(CASE WHEN {contains_any(h, cfg.action_terms)} THEN least(100, {base} + {C.ACTION_BONUS}) ELSE {base} END)"
        tier = f"(CASE WHEN {nh} > 0 THEN 0 WHEN {nl} > 0 OR {nu} > 0 THEN 1 ELSE 2 END)"
        kinds = [C.STRONG, C.POSSIBLE, C.LOW]
        return (f"struct_pack(candidate_score := {score}, matched := list_concat({hits(h, cfg.high_keywords)}, "
                f"{hits(h, cfg.low_keywords)}), candidate_type := CASE {tier} WHEN 0 THEN {q(kinds[0][0])} WHEN 1 THEN "
                f"{q(kinds[1][0])} ELSE {q(kinds[2][0])} END, reason := CASE {tier} WHEN 0 THEN {q(kinds[0][1])} WHEN 1 "
                f"THEN {q(kinds[1][1])} ELSE {q(kinds[2][1])} END)")
    return let(hay, body)


def strip_chars(e: str, chars: str) -> str:
    cls = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars)
    return f"regexp_replace({e}, {q(f'^[{cls}]+|[{cls}]+$')}, '', 'g')"


def clipped(e: str, chars) -> str:
    return e if chars is None else f"left({e}, {chars})"


def first_match(text: str, patterns, chars=None) -> str:
    out = "'Unknown'"
    for pat in reversed(list(patterns)):
        rp = "(?i)" + pat
        grp = f"regexp_replace(regexp_extract({text}, {q(rp)}, 1), {q(WS + '+')}, ' ', 'g')"
        val = clipped(strip_chars(grp, C.MATCH_STRIP_CHARS), chars)
        out = f"(CASE WHEN regexp_matches({text}, {q(rp)}) THEN {val} ELSE {out} END)"
    return out


def whole_word(text: str, words) -> str:
    alt = "|".join(words)
    return f"regexp_matches({text}, {q(f'(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{alt})($|[^\\p{{L}}\\p{{N}}_])')})"


def language(text: str, cfg: C.MiningConfig) -> str:
    out = "'Unknown'"
    for label, word in reversed(cfg.language_words):
        out = f"(CASE WHEN {whole_word(text, [word])} THEN {q(label)} ELSE {out} END)"
    return out


def housing(text: str, cfg: C.MiningConfig) -> str:
    return f"(CASE WHEN {whole_word(text, cfg.housing_words)} THEN 'Available' ELSE 'Unknown' END)"


def programme_type(text: str, url: str, cfg: C.MiningConfig) -> str:
    def body(h):
        out = "'Unknown'"
        for label, terms in reversed(cfg.programme_types):
            out = f"(CASE WHEN {contains_any(h, terms)} THEN {q(label)} ELSE {out} END)"
        return out
    return let(f"lower(concat_ws(' ', {text}, {url}))", body)


def clean_name(e: str, cfg: C.MiningConfig) -> str:
    pat = cfg.name_suffix_pattern.replace(r"\s", WS)
    return ustrip(f"regexp_replace({e}, {q('(?i)' + pat)}, '', 'g')")


def title_case(e: str) -> str:
    x = v()
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '(\\p{{L}}+|[^\\p{{L}}]+)', 1), lambda {x}: "
            f"upper(substring({x}, 1, 1)) || lower(substring({x}, 2, 1073741824))), '')")


def url_name(u: str) -> str:
    return title_case(ustrip(f"regexp_replace({path_tail(u)}, '[-_]+', ' ', 'g')"))


def infer_name(title: str, heading_: str, url: str, cfg: C.MiningConfig) -> str:
    """struct(name, inferred)"""
    def pick(h, t):
        from_url = let(url_name(url), lambda n: f"CASE WHEN {n} <> '' THEN {n} ELSE 'Unknown Programme' END")
        return (f"CASE WHEN length({h}) >= {C.MIN_NAME_CHARS} THEN struct_pack(name := {clipped(h, cfg.name_chars)}, inferred := FALSE) "
                f"WHEN length({t}) >= {C.MIN_NAME_CHARS} THEN struct_pack(name := {clipped(t, cfg.name_chars)}, inferred := TRUE) "
                f"ELSE struct_pack(name := {from_url}, inferred := TRUE) END")
    return let(clean_name(f"coalesce({heading_}, '')", cfg),
               lambda h: let(clean_name(f"coalesce({title}, '')", cfg), lambda t: pick(h, t)))


def is_missing(e: str) -> str:
    tokens = ", ".join(q(t) for t in C.MISSING_TOKENS)
    return let(f"lower({ustrip(e)})", lambda x: f"coalesce({x} = '' OR {x} IN ({tokens}), TRUE)")


def name_key(e: str) -> str:
    w = v()
    spaced = f"regexp_replace(regexp_replace(lower(coalesce({e}, '')), 'https?://', '', 'g'), '[^a-z0-9]+', ' ', 'g')"
    stops = ", ".join(q(s) for s in C.DUPLICATE_STOP_WORDS)
    return (f"array_to_string(list_filter(string_split(trim({spaced}), ' '), lambda {w}: {w} <> '' AND "
            f"{w} NOT IN ({stops})), ' ')")


# -- similarity ----------------------------------------------------------------
def _longest_block(a: str, b: str) -> str:
    """struct(k, i, j): longest common substring, earliest in ``a``, then in ``b``; k = 0 if none."""
    i, k = v(), v()
    best = (f"list_sort(list_transform(range(1, length({a}) + 1), lambda {i}: struct_pack(neg := -coalesce(list_max(list_filter("
            f"range(1, length({a}) - {i} + 2), lambda {k}: strpos({b}, substring({a}, {i}, {k})) > 0)), 0), i := {i})))[1]")
    return let(best, lambda m: f"struct_pack(k := -{m}.neg, i := {m}.i, j := strpos({b}, substring({a}, {m}.i, -{m}.neg)))")


def leader_ctes(src: str, ratio: float, p: str) -> str:
    """CTEs over ``src(row_idx, nkey, bnet, bpath, elig)``; the last, ``{p}leader``, adds ``leader``.

    The ratio is twice the characters in matching blocks over all characters:
    the longest common block, then the same left and right of it.  Keys shorter
    than 200 characters are assumed, as longer ones are compared differently.
    """
    c = v()
    common = (f"list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz0123456789 ', ''), lambda {c}: least("
              f"length(x.nkey) - length(replace(x.nkey, {c}, '')), length(y.nkey) - length(replace(y.nkey, {c}, '')))))")
    left, right = "substring(a, 1, m.i - 1), b := substring(b, 1, m.j - 1)", "substring(a, m.i + m.k), b := substring(b, m.j + m.k)"
    h = v()
    return f"""
{p}keys AS (SELECT bnet, bpath, nkey, min(row_idx) AS rep FROM {src} WHERE elig GROUP BY bnet, bpath, nkey),
{p}order AS (SELECT *, row_number() OVER (PARTITION BY bnet, bpath ORDER BY rep) AS n FROM {p}keys),
{p}pairs AS (SELECT x.bnet, x.bpath, x.n AS ln, y.n AS rn, y.nkey AS a, x.nkey AS b, length(x.nkey) + length(y.nkey) AS total
    FROM {p}order x JOIN {p}order y ON x.bnet = y.bnet AND x.bpath = y.bpath AND x.n < y.n
    WHERE 2.0 * least(length(x.nkey), length(y.nkey)) >= {ratio} * (length(x.nkey) + length(y.nkey))
      AND 2.0 * {common} >= {ratio} * (length(x.nkey) + length(y.nkey))),
{p}steps AS (SELECT bnet, bpath, ln, rn, total, a, b, {_longest_block('a', 'b')} AS m FROM {p}pairs
    UNION ALL SELECT bnet, bpath, ln, rn, total, c.a AS a, c.b AS b, {_longest_block('c.a', 'c.b')} AS m FROM (
        SELECT bnet, bpath, ln, rn, total, unnest([struct_pack(a := {left}), struct_pack(a := {right})]) AS c
        FROM {p}steps WHERE m.k > 0) WHERE c.a <> '' AND c.b <> ''),
{p}like AS (SELECT bnet, bpath, ln, rn FROM {p}steps GROUP BY bnet, bpath, ln, rn, total HAVING 2.0 * sum(m.k) / total >= {ratio}),
{p}known AS (SELECT o.bnet, o.bpath, o.n, o.nkey, o.rep, coalesce(l.ls, []::BIGINT[]) AS ls FROM {p}order o LEFT JOIN
    (SELECT bnet, bpath, rn, list(ln) AS ls FROM {p}like GROUP BY bnet, bpath, rn) l ON o.bnet = l.bnet AND o.bpath = l.bpath AND o.n = l.rn),
{p}scan AS (SELECT bnet, bpath, n, [n] AS leaders, n AS lead FROM {p}known WHERE n = 1
    UNION ALL SELECT bnet, bpath, n, CASE WHEN hit IS NULL THEN list_append(leaders, n) ELSE leaders END AS leaders, coalesce(hit, n) AS lead
    FROM (SELECT k.bnet, k.bpath, k.n, s.leaders, list_filter(s.leaders, lambda {h}: list_contains(k.ls, {h}))[1] AS hit
          FROM {p}scan s JOIN {p}known k ON k.bnet = s.bnet AND k.bpath = s.bpath AND k.n = s.n + 1)),
{p}lead AS (SELECT k.bnet, k.bpath, k.nkey, d.rep AS leader FROM {p}known k
    JOIN {p}scan s ON s.bnet = k.bnet AND s.bpath = k.bpath AND s.n = k.n
    JOIN {p}order d ON d.bnet = k.bnet AND d.bpath = k.bpath AND d.n = s.lead),
{p}leader AS (SELECT r.*, coalesce(l.leader, r.row_idx) AS leader FROM {src} r LEFT JOIN {p}lead l
    ON r.elig AND l.bnet = r.bnet AND l.bpath = r.bpath AND l.nkey = r.nkey)"""


def marks(src: str, out: str) -> str:
    """CTEs that number the groups of ``src(row_idx, leader, ...)``: ``{out}`` adds ``group_no, gsize``."""
    return f"""
{out}_l AS (SELECT row_idx AS leader, row_number() OVER (ORDER BY row_idx) AS group_no FROM {src} WHERE leader = row_idx),
{out} AS (SELECT r.*, l.group_no, count(*) OVER (PARTITION BY r.leader) AS gsize FROM {src} r JOIN {out}_l l ON r.leader = l.leader)"""
