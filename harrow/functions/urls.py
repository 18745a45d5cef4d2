"""Column -> Column URL expressions.

URLs are split with the RFC 3986 appendix-B expression through
``regexp_extract`` rather than ``parse_url``: ``parse_url`` throws under ANSI
mode and ``try_parse_url`` gives NULL for hosts with '_' or paths with spaces.
Re-assembly lower-cases the scheme, drops the fragment and an empty query, and
removes tabs/newlines, like the URL handling being reproduced.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, ustrip

SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Schemes whose URLs carry a '//' authority on re-assembly.
NETLOC_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
    "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync", "svn",
    "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
]


def _part(u: Column, i: int) -> Column:
    return F.regexp_extract(u, SPLIT, i)


def scheme(u: Column) -> Column:
    return F.lower(_part(u, 1))


def netloc(u: Column) -> Column:
    return _part(u, 2)


def path(u: Column) -> Column:
    return _part(u, 3)


def query(u: Column) -> Column:
    return _part(u, 4)


def host(u: Column) -> Column:
    """Host of a URL: netloc minus userinfo and port, lower-cased ('' if none)."""
    return let(F.regexp_replace(netloc(u), r"^.*@", ""), lambda info: F.lower(
        F.when(info.contains("["), F.regexp_extract(info, r"\[([^\]]*)", 1))
        .otherwise(F.substring_index(info, ":", 1))))


def parts(u: Column) -> Column:
    """The URL split once into ``struct(scheme, netloc, path, query)``."""
    return let(u, lambda x: F.struct(scheme(x).alias("scheme"), netloc(x).alias("netloc"),
                                     path(x).alias("path"), query(x).alias("query")))


def _assemble(sch: Column, net: Column, pth: Column, qry: Column) -> Column:
    netloc_scheme = sch.isin(*[s for s in NETLOC_SCHEMES if s])
    body = (F.when(net != "", F.concat(F.lit("//"), net, F.when((pth != "") & ~pth.startswith("/"),
                                                               F.concat(F.lit("/"), pth)).otherwise(pth)))
            .when(pth.startswith("//"), F.concat(F.lit("//"), pth))
            .when(netloc_scheme & ((pth == "") | pth.startswith("/")), F.concat(F.lit("//"), pth))
            .otherwise(pth))
    return F.concat(
        F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
        body,
        F.when(qry != "", F.concat(F.lit("?"), qry)).otherwise(F.lit("")),
    )


# Schemes whose last path segment carries ';params'.
PARAM_SCHEMES = ["", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu",
                 "sip", "sips", "mms", "sftp", "tel"]
EMPTY_PARAMS = r"^((?:.*/)?[^/;]*);$"


def _assemble_parts(st: Column) -> Column:
    # An empty ';params' on the last segment is dropped on re-assembly.
    p = F.when(st["path"].contains(";") & st["scheme"].isin(*PARAM_SCHEMES), F.regexp_replace(st["path"], EMPTY_PARAMS, "$1")) \
        .otherwise(st["path"])
    return _assemble(st["scheme"], st["netloc"], p, st["query"])


def normalise_url(u: Column) -> Column:
    """Trim, drop fragment, default scheme https, strip all trailing '/'."""
    cleaned = F.regexp_replace(ustrip(u), r"[\t\r\n]", "")
    with_scheme = let(cleaned, lambda s: F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), s)
                      .otherwise(F.concat(F.lit("https://"), s)))
    return F.regexp_replace(let(parts(with_scheme), _assemble_parts), r"/+$", "")


def normalise_domain(v: Column) -> Column:
    """Host of a URL or a bare domain, lower-cased, minus one leading 'www.'."""
    def body(val):
        as_url = F.when(val.contains("://"), val).otherwise(F.concat(F.lit("https://"), val))
        return let(host(as_url), lambda h: F.regexp_replace(F.when(h != "", h).otherwise(val), r"^www\.", ""))
    return let(F.lower(ustrip(v)), body)


def is_allowed(u: Column, domain: Column, normalised_domain: bool = False) -> Column:
    """http(s) URL whose host (minus one 'www.') is the domain or below it."""
    d = domain if normalised_domain else normalise_domain(domain)
    return scheme(u).isin("http", "https") & let(
        F.regexp_replace(host(u), r"^www\.", ""),
        lambda h: (h == d) | h.endswith(F.concat(F.lit("."), d)))


def should_skip(u: Column, cfg) -> Column:
    return let(F.lower(u), lambda low: _skip_lower(low, cfg))


def _skip_lower(low: Column, cfg) -> Column:
    cond = F.lit(False)
    for s in cfg.skip_schemes:
        cond = cond | low.startswith(s)
    for e in cfg.negative_extensions:
        cond = cond | low.endswith(e)
    for p in cfg.avoid_url_parts:
        cond = cond | low.contains(p)
    return cond


def well_formed(u: Column) -> Column:
    """Whether a URL can be split: the brackets of its host, if any, are closed."""
    net = netloc(u)
    return F.when(u.contains("[") | u.contains("]"), net.contains("[") == net.contains("]")).otherwise(F.lit(True))


def slash_count(u: Column) -> Column:
    return F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))


def should_enqueue(u: Column, domain: Column, cfg, max_slashes: int = 5, normalised_domain: bool = False) -> Column:
    """Link filter applied before a link is queued (skip list, domain, hints)."""
    def body(low):
        hinted = F.lit(False)
        for h in cfg.url_hints:
            hinted = hinted | low.contains(h)
        return ~_skip_lower(low, cfg) & (hinted | (slash_count(low) <= max_slashes))
    return let(F.lower(u), body) & is_allowed(u, domain, normalised_domain)


def _drop_empty_middle(segs: Column) -> Column:
    """Drop empty inner segments (a relative merge must not double '/')."""
    n = F.size(segs)
    middle = F.filter(F.slice(segs, 2, F.greatest(n - 2, F.lit(0))), lambda x: x != "")
    return F.when(n >= 2, F.concat(F.slice(segs, 1, 1), middle, F.slice(segs, -1, 1))).otherwise(segs)


def _dot_segments(segs: Column) -> Column:
    """Remove '.' and '..' segments."""
    return let(segs, _dot_resolve)


def _dot_resolve(segs2: Column) -> Column:
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        segs2, empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))))
    last = F.get(segs2, F.size(segs2) - 1)
    resolved = let(resolved, lambda r: F.when(last.isin(".", ".."), F.concat(r, F.array(F.lit("")))).otherwise(r))
    return let(F.array_join(resolved, "/"), lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def resolve(base: Column, href: Column) -> Column:
    """Resolve ``href`` against the page URL ``base`` (RFC 3986 merge)."""
    return let(parts(base), lambda b: resolve_split(base, b, href))


def resolve_split(base: Column, split: Column, href: Column) -> Column:
    """As :func:`resolve`, with the :func:`parts` of ``base``, for many links of one page."""
    h0 = F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]", ""), r"^[\x00-\x20]+", "")
    return let(h0, lambda h: _resolve_bound(base, split, h))


def _resolve_bound(base: Column, b: Column, h: Column) -> Column:
    b_s, b_n, b_p, b_q = b["scheme"], b["netloc"], b["path"], b["query"]
    h_s = F.lower(F.regexp_extract(h, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.when((h_s != "") & (h_s == b_s), F.regexp_replace(h, r"^[A-Za-z][A-Za-z0-9+.-]*:", "")).otherwise(h)

    def with_rest(r):
        r_n = F.regexp_extract(r, r"^//([^/?#]*)", 1)
        no_auth = F.regexp_replace(r, r"^//[^/?#]*", "")
        # An empty ';params' on the last segment is dropped before merging.
        r_p = F.regexp_replace(F.regexp_extract(no_auth, r"^([^?#]*)", 1), EMPTY_PARAMS, "$1")
        r_q = F.regexp_extract(no_auth, r"^[^?#]*\?([^#]*)", 1)
        return let(F.struct(r_n.alias("n"), r_p.alias("p"), r_q.alias("q")), lambda rp: _merge(base, b, h, h_s, rp))
    return let(rest, with_rest)


def _merge(base, b, h, h_s, rp):
    b_s, b_n, b_p, b_q = b["scheme"], b["netloc"], b["path"], b["query"]
    r_n, r_p, r_q = rp["n"], rp["p"], rp["q"]
    base_dir = let(F.split(b_p, "/", -1), lambda d: F.when(
        F.get(d, F.size(d) - 1) != "", F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0)))).otherwise(d))
    segs = F.when(r_p.startswith("/"), F.split(r_p, "/", -1)).otherwise(
        _drop_empty_middle(F.concat(base_dir, F.split(r_p, "/", -1))))
    return (
        F.when(h == "", base)
        .when((h_s != "") & (h_s != b_s), h)
        .when(r_n != "", _assemble(b_s, r_n, r_p, r_q))
        .when(r_p == "", _assemble(b_s, b_n, b_p, F.when(r_q != "", r_q).otherwise(b_q)))
        .otherwise(_assemble(b_s, b_n, let(segs, _dot_segments), r_q))
    )


def path_tail(u: Column) -> Column:
    """Last segment of the path (';params' cut), trailing '/' ignored."""
    p = F.regexp_replace(F.regexp_replace(path(u), r";[^/]*$", ""), r"/+$", "")
    return F.substring_index(p, "/", -1)


def block_path(u: Column) -> Column:
    """Path minus ';params' of the last segment and minus trailing '/'."""
    return F.regexp_replace(F.regexp_replace(path(u), r";[^/]*$", ""), r"/+$", "")


def host_suffixes(h: Column) -> Column:
    """All dot-suffixes of a host: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(h, r"\.", -1)
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                       lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
