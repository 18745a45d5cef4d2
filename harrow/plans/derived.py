"""Inputs derived by Spark from the captured tables (targets, extra edges).

The captured pages hold almost no in-site links, so for the crawl to do real
work the seed of a site also links to hubs, and a hub to the captures after it,
as an index page would: two levels reach every capture of a site of any size.
All frames are computed from ``pages`` and grow with it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MAX_PATH_SLASHES, TEST
from ..functions.ordinal import FAN, bucket_ordinal, rank_in_pieces
from ..functions.staging import staged
from ..functions.urls import netloc, normalise_domain, normalise_url, scheme, should_enqueue
from ..sources.targets import clean_targets, targets_from_pages


def derived_targets(pages: DataFrame) -> DataFrame:
    """One target per site; every third leaves its domain blank, with blanks around the name, as a file may."""
    raw = targets_from_pages(pages)
    third = F.col("target_idx") % 3 == 1
    return clean_targets(raw.withColumn("allowed_domain", F.when(third, F.lit(" ")).otherwise(F.col("allowed_domain")))
                         .withColumn("name", F.when(third, F.concat(F.lit(" "), F.col("name"), F.lit("\t"))).otherwise(F.col("name"))),
                         validate=False)


def derived_captures(pages: DataFrame) -> DataFrame:
    """Captures with a status, a content type and an error text, by rule on ``page_id``."""
    i = F.col("page_id")
    return pages.withColumns({
        "status": F.when(i % 11 == 5, F.lit(404)).when(i % 13 == 6, F.lit(503)).otherwise(F.lit(200)),
        "content_type": F.when(i % 7 == 3, F.lit("application/pdf")).when(i % 5 == 1, F.lit("Application/XHTML+xml"))
        .when(i % 17 == 2, F.lit(None).cast("string")).otherwise(F.lit("text/html; charset=utf-8")),
        "error": F.when(i % 13 == 6, F.lit("503 Server Error")),
    })


def derived_edges(pages: DataFrame, following: int = 0) -> DataFrame:
    """Seed -> every ``ceil(sqrt(n))``-th of the ``n`` captures of its site, and each of these hubs -> those up to the next.

    Captures that a crawl would queue come first, then the others, each in the
    order of ``page_id``, so that a hub that isn't queued has none after it that is.
    The rank inside a site comes from per-(site, id range) pieces plus offsets, and
    both kinds of edges from an equi-join on ``(site, rank)`` of captures and hubs,
    so a site with a third of all pages is still spread over many tasks.

    With ``following`` each capture also links to that many after it by ``page_id``,
    so that what hangs on a hub which can't be read, and what hubs' neighbours link to, is reached by these.
    """
    nurl = normalise_url(F.col("url"))
    queued = should_enqueue(F.col("nurl"), normalise_domain(F.col("nurl")), TEST, MAX_PATH_SLASHES, True)
    p = pages.select("page_id", "url", nurl.alias("nurl")).withColumn("site", F.lower(netloc(F.col("nurl")))) \
        .withColumn("late", (~queued).cast("int"))
    ranked = rank_in_pieces(p.select("page_id", "url", "site", "late"), ["site"],
                            [F.col("late"), F.floor(F.col("page_id") / FAN)], ["page_id"], "rk").withColumn("rk", F.col("rk") - 1)
    per_site = p.filter(scheme(F.col("nurl")).isin("http", "https")).groupBy("site").agg(F.min("url").alias("seed"))
    sizes = p.groupBy("site").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("step"))
    ranked = staged(ranked.join(sizes, "site"), "captures")
    hubs = ranked.filter(F.col("rk") % F.col("step") == 0).select("site", F.col("rk").alias("hub"), F.col("url").alias("src"))
    from_seed = hubs.join(per_site, "site").select(F.col("seed").alias("src"), F.col("src").alias("dst"))
    later = ranked.filter(F.col("rk") % F.col("step") != 0) \
        .select("site", (F.col("rk") - F.col("rk") % F.col("step")).alias("hub"), F.col("url").alias("dst"))
    edges = from_seed.unionByName(later.join(hubs, ["site", "hub"]).select("src", "dst"))
    if not following:
        return edges
    chain = staged(bucket_ordinal(p.select("page_id", "url", "site"), "page_id", "at", group=["site"]), "chain")
    src = chain.select("site", F.col("url").alias("src"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + following)).alias("at"))
    return edges.unionByName(src.join(chain.select("site", "at", F.col("url").alias("dst")), ["site", "at"]).select("src", "dst"))


def derived_robots(pages: DataFrame) -> DataFrame:
    """A robots file per derived target, built from the site's own paths.

    Each site disallows the language section of its highest page id and allows
    the section of its lowest, so the gate both blocks and allows real URLs.
    """
    t = derived_targets(pages)
    site = F.lower(netloc(normalise_url(F.col("url"))))
    sec = F.regexp_extract(normalise_url(F.col("url")), r"^[a-z]+://[^/]+(/[^/?#]*)", 1)
    per_site = pages.select(site.alias("site"), "page_id", sec.alias("sec")).groupBy("site").agg(
        F.min_by("sec", "page_id").alias("first_sec"), F.max_by("sec", "page_id").alias("last_sec"))
    tsite = t.select("target_idx", F.lower(netloc(normalise_url(F.col("seed_url")))).alias("site"))
    body = F.concat(
        F.lit("# robots\nUser-agent: OtherBot\nDisallow: /\n\nUser-agent: *\nAllow: "), F.col("first_sec"),
        F.lit("\nDisallow: "), F.col("last_sec"), F.lit("\n"))
    # Every fourth file: an orphan rule, agents in a row, comments, other directives, blank lines, rules after the default group.
    several = F.concat(
        F.lit("Disallow: /orphan\n\nUser-agent: OtherBot\nUser-agent: HARROW # this one\nCrawl-delay: 3\nDisallow: "), F.col("last_sec"),
        F.lit(" # note\nAllow: "), F.col("first_sec"), F.lit("\nSitemap: https://x.test/s\n\n\nUser-agent: *\nDisallow: /\nUser-agent: late\nAllow: /\n"))
    return tsite.join(per_site, "site").select(
        "target_idx",
        F.when(F.col("target_idx") % 5 == 4, F.lit(404)).otherwise(F.lit(200)).alias("status"),
        F.when(F.col("target_idx") % 4 == 1, several).otherwise(body).alias("body"))
