"""Captured pages: the re-aimed page source (replaces live HTTP reads).

Input ``pages(page_id, url, html[, status, content_type, error])``.  Each row is
keyed by its normalised URL; when several captures normalise to one key the
first by ``page_id`` wins.  Optional columns default to a good HTML response.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import few, probable_members, staged
from ..functions.urls import host, host_suffixes, normalise_url, scheme


def with_capture_status(pages: DataFrame) -> DataFrame:
    """Add ``status``/``content_type``/``error`` defaults and the read outcome.

    ``failure`` is the warning text for a failed read (status >= 400); a
    non-HTML response is not a failure but yields no content.
    """
    cols = set(pages.columns)
    status = F.col("status") if "status" in cols else F.lit(200)
    ctype = F.col("content_type") if "content_type" in cols else F.lit("text/html")
    error = F.col("error") if "error" in cols else F.lit(None).cast("string")
    lowered = F.lower(F.coalesce(ctype, F.lit("")))
    is_html = lowered.contains("text/html") | lowered.contains("application/xhtml")
    failed = F.coalesce(status >= 400, F.lit(False)) | error.isNotNull()
    return pages.select(
        "page_id", "url", "html",
        F.when(failed, F.coalesce(error, F.concat(F.lit("HTTP status "), status.cast("string"))))
        .alias("failure"),
        (~failed & is_html).alias("is_html"),
    )


def first_captures(pages: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """``(url, page_id)`` of the capture that counts for each URL, from narrow columns only.

    ``pages`` holds normalised URLs.  The minimum is aggregated partially where
    the rows are read, so a URL captured millions of times never lands in one
    task.  With ``domains(domain)`` only URLs whose host lies in one of the
    domains are kept, by an equi-join of the host's dot-suffixes.
    """
    keys = pages.select("url", "page_id")
    if domains is not None:
        keys = in_domains(keys, domains)
    return keys.groupBy("url").agg(F.min("page_id").alias("page_id"))


def pages_normalised(pages: DataFrame, domains: DataFrame | None = None, narrow=None, urls: DataFrame | None = None) -> DataFrame:
    """One row per normalised URL, its first capture, as ``narrow`` leaves it.

    ``narrow`` (a parse, say) is applied where the rows are read and has to drop
    ``html``; by default that is all it does, so HTML is never shuffled.  Rows
    that cannot be a first capture in scope are left out before it by a bitmap
    of at most 8 MB; the exact join follows on what it returns.  Of captures
    that agree in URL and ``page_id`` one stays.  With ``urls(url)`` only these are of interest.
    """
    keyed = with_capture_status(pages).withColumn("url", normalise_url(F.col("url")))
    first = first_captures(keyed, domains).withColumnRenamed("page_id", "_first")
    if urls is not None:
        first = first.join(urls.select("url").distinct(), "url", "left_semi")
    first = staged(first, "first-captures")
    rows = probable_members(keyed, F.xxhash64("url", "page_id"), first, F.xxhash64("url", "_first"))
    rows = narrow(rows) if narrow is not None else rows.drop("html")
    return rows.join(first, "url").filter(F.col("page_id").eqNullSafe(F.col("_first"))).drop("_first").dropDuplicates(["url"])


#: So many domain names go to all tasks: at most 253 bytes each, 13 MB together.
FEW_DOMAINS = 50_000
LONGEST_HOST = 253
SALTS = 16


def match_domains(keys: DataFrame, domains: DataFrame, few_domains: int = FEW_DOMAINS) -> DataFrame:
    """``keys(url, ...)`` joined with the ``domains(domain, ...)`` that are its host (less ``www.``) or a dot-suffix of it.

    A suffix like ``com`` that ends most hosts is no domain: it must not reach a
    shuffle.  A few names are broadcast, so nothing is shuffled at all.  More of
    them first leave out, by a bitmap, the suffixes that are none of them; the
    rest is joined on (suffix, salt), so that rows of a domain with a third of
    all pages go to ``SALTS`` tasks.
    """
    sfx = keys.withColumn("domain", F.explode(host_suffixes(F.regexp_replace(host(F.col("url")), r"^www\.", ""))))
    if few(domains.filter(F.length("domain") <= LONGEST_HOST), few_domains) and domains.filter(F.length("domain") > LONGEST_HOST).isEmpty():
        return sfx.join(F.broadcast(domains), "domain")
    sfx = probable_members(sfx, F.xxhash64("domain"), domains, F.xxhash64("domain"))
    salted = domains.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return sfx.withColumn("_salt", F.pmod(F.xxhash64(*keys.columns), F.lit(SALTS)).cast("int")).join(salted, ["domain", "_salt"]).drop("_salt")


def in_domains(keys: DataFrame, domains: DataFrame, few_domains: int = FEW_DOMAINS) -> DataFrame:
    """Rows of ``keys(url, ...)`` whose http(s) host is a domain or below one.

    A row may match several nested domains; callers aggregate or semi-join.
    """
    web = keys.filter(scheme(F.col("url")).isin("http", "https"))
    return match_domains(web, domains.select("domain").distinct(), few_domains).drop("domain")
