"""Queries over the driver tables, each with its DuckDB oracle.

Every query reads the captured tables (``pages``, ``documents``) or frames
Spark derives from them (targets per site, next-page edges, robots files), on
the whole tables.  The lexicon is ``config.TEST`` (the default lexicon almost
never fires on the synthetic prose); rules, weights and limits are the default
ones.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL`` with
identical column names.
"""
from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..config import TEST
from ..functions.ordinal import range_ordinal
from ..functions.staging import scratch, staged
from ..functions.urls import is_allowed, netloc, normalise_domain, normalise_url, should_enqueue, should_skip
from ..operators import extract as X
from ..operators.content import page_content
from ..operators.dedupe import assign_groups, block_key, name_key
from ..operators.scoring import score_by_table, score_columns
from ..sources.pages import match_domains, pages_normalised, with_capture_status
from ..sources.robots import robots_flag, robots_rules
from ..sources.sinks import candidate_report, row_highlight, warnings_report
from ..sources.targets import read_targets, targets_from_pages
from .derived import derived_captures, derived_edges, derived_robots, derived_targets
from .job import run_job

RUN_TS = _dt.datetime(2026, 1, 2, 3, 4, 5)
RUN_DATE = "2026-01-02"
CAP_SMALL = 4
#: So many captures of its site a capture links to in the jobs "robots" and "following", beside the index pages.
FOLLOWING = 3


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Results shared by several queries are kept per session, folder and state of
# its files: the driver runs the queries one after another in one session.
_memo: dict = {}


def _memoised(spark, sf, name, fn):
    files = tuple(sorted(read_files(spark, sf, "pages")))
    key = (spark.sparkContext.applicationId, sf, files, name)
    if key not in _memo:
        _memo[key] = fn()
    return _memo[key]


def read_files(spark, sf, name):
    """``(path, length, time)`` of a table's files, from the file system that Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(path)]


def _content(spark, sf):
    def build():
        pages = _read(spark, sf, "pages")
        c = score_columns(page_content(pages.withColumn("url", normalise_url(F.col("url")))), TEST)
        return staged(c, "content")
    return _memoised(spark, sf, "content", build)


def _job(spark, sf, variant="main"):
    def build():
        pages = _read(spark, sf, "pages")
        targets = derived_targets(pages)
        cfg = {"limit4": TEST.with_(max_pages=CAP_SMALL), "limits": TEST.with_(**C.CRAWL_LIMITS)}.get(variant, TEST)
        detail = _emptied_detail(pages) if variant in ("fallback", "limits") else None
        robots = derived_robots(pages) if variant in ("robots", "limits") else None
        captures = derived_captures(pages) if variant in ("robots", "limits") else pages
        edges = derived_edges(pages, FOLLOWING if variant in ("robots", "following") else 0)
        return run_job(targets, captures, cfg, edges=edges, detail_pages=detail, robots=robots,
                       run_ts=RUN_TS, end_ts=RUN_TS)
    return _memoised(spark, sf, ("job", variant), build)


def _emptied_detail(pages: DataFrame) -> DataFrame:
    """Second read where every third site (by site order) returns empty HTML."""
    site = F.lower(netloc(normalise_url(F.col("url"))))
    ranked = pages.withColumn("_site", site)
    sites = range_ordinal(ranked.select("_site").distinct(), "_site", "_rank").withColumn("_rank", F.col("_rank") - 1)
    return ranked.join(sites, "_site").withColumn(
        "html", F.when(F.col("_rank") % 3 == 0, F.lit("")).otherwise(F.col("html"))).drop("_site", "_rank")


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------
def q_pages_normalised(spark, sf):
    return pages_normalised(_read(spark, sf, "pages")).select("url", "page_id")


def q_captures(spark, sf):
    return with_capture_status(derived_captures(_read(spark, sf, "pages"))).select("page_id", "failure", "is_html")


def q_page_text(spark, sf):
    return page_content(_read(spark, sf, "pages"), with_links=False).select("page_id", "title", "text")


def q_page_heading(spark, sf):
    return page_content(_read(spark, sf, "pages"), with_links=False).select("page_id", "heading")


def q_page_links(spark, sf):
    return _content(spark, sf).select("page_id", F.array_join("links", " ").alias("links"),
                                      F.size("links").alias("n_links"))


def q_page_scores(spark, sf):
    return _content(spark, sf).select("page_id", "url", "candidate_score",
                                      F.array_join("matched_keywords", ", ").alias("matched_keywords"),
                                      "candidate_type", "reason")


def site_lexicon(content: DataFrame) -> DataFrame:
    """A lexicon of thousands of terms, made of the pages' own titles and hosts.

    High: titles' words of 8 letters and more; low: those of 5 to 7; url: the host names; action: the last two letters of titles.
    """
    words = content.select(F.explode(F.split(F.lower("title"), "[^\\p{L}]+")).alias("term"))
    high = words.filter(F.length("term") >= 8).select(F.lit("high").alias("kind"), "term")
    low = words.filter(F.length("term").between(5, 7)).select(F.lit("low").alias("kind"), "term")
    url = content.select(F.lit("url").alias("kind"), F.lower(netloc(F.col("url"))).alias("term"))
    action = content.filter("length(title) > 40").select(F.lit("action").alias("kind"), F.lower(F.substring("title", -2, 2)).alias("term"))
    terms = high.unionByName(low).unionByName(url).unionByName(action).distinct()
    return range_ordinal(terms.withColumn("_t", F.concat_ws(" ", "kind", "term")), "_t", "pos").select("kind", F.col("pos").cast("int").alias("pos"), "term")


def q_page_scores_lexicon(spark, sf):
    content = _content(spark, sf).drop("candidate_score", "matched_keywords", "candidate_type", "reason")
    return score_by_table(content, staged(site_lexicon(content), "lexicon"), "page_id", TEST).select(
        "page_id", "candidate_score", F.array_join("matched_keywords", ", ").alias("matched_keywords"), "candidate_type", "reason")


def _exploded_links(spark, sf):
    return _content(spark, sf).select("page_id", "url", F.explode("links").alias("link"))


def q_url_skip(spark, sf):
    return _exploded_links(spark, sf).select("page_id", "link", should_skip(F.col("link"), TEST).alias("skip"))


def q_frontier_filter(spark, sf):
    return _exploded_links(spark, sf).select(
        "page_id", "link",
        should_enqueue(F.col("link"), normalise_domain(F.col("url")), TEST, C.MAX_PATH_SLASHES, True).alias("enqueue"))


def q_domain_allowed(spark, sf):
    p = _read(spark, sf, "pages").withColumn("_own", normalise_domain(F.col("url")))
    return p.select(
        "page_id",
        is_allowed(F.col("url"), F.col("_own"), True).alias("allowed_own"),
        is_allowed(F.col("url"), F.regexp_replace(F.col("_own"), r"^[^.]+\.", ""), True).alias("allowed_parent"),
        is_allowed(F.col("url"), F.lit("www.Example.com")).alias("allowed_example_com"),
    )


def q_targets_clean(spark, sf):
    return derived_targets(_read(spark, sf, "pages"))


def q_pages_per_target(spark, sf):
    pages = _read(spark, sf, "pages").withColumn("url", normalise_url(F.col("url")))
    t = derived_targets(_read(spark, sf, "pages")).select(
        "target_idx", normalise_domain(F.col("allowed_domain")).alias("domain"))
    return match_domains(pages.select("page_id", "url"), staged(t, "domains")).select("target_idx", "page_id")


def q_programme_name(spark, sf):
    c = _content(spark, sf).withColumn("_n", X.infer_name(F.col("title"), F.col("heading"), F.col("url"), TEST))
    return c.select("page_id", F.col("_n.name").alias("programme_name"), F.col("_n.inferred").alias("inferred"))


def q_first_match(spark, sf):
    c = _content(spark, sf).withColumn("_low", X.folded(F.col("text")))
    return c.select("page_id", *[X.first_match(F.col("text"), TEST.field_patterns[f], low=F.col("_low")).alias(f) for f in X.FIELD_ORDER])


def q_language_flag(spark, sf):
    return _content(spark, sf).select("page_id", X.language(F.col("text"), TEST).alias("language"))


def q_housing_flag(spark, sf):
    return _content(spark, sf).select("page_id", X.housing(F.col("text"), TEST).alias("housing"))


def q_programme_type(spark, sf):
    return _content(spark, sf).select("page_id", X.programme_type(F.col("text"), F.col("url"), TEST).alias("programme_type"))


def _docs(spark, sf):
    d = _read(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("row_idx"), F.col("text").alias("name"),
                    F.concat(F.lit("https://"), F.col("source")).alias("url"))


def q_dup_name_key(spark, sf):
    return _docs(spark, sf).select(F.col("row_idx").alias("doc_id"), name_key(F.col("name")).alias("name_key"))


def q_dup_block_key(spark, sf):
    return _read(spark, sf, "pages").withColumn("_b", block_key(F.col("url"))).select(
        "page_id", F.col("_b.netloc").alias("block_netloc"), F.col("_b.path").alias("block_path"))


def q_near_dup_exact(spark, sf):
    return assign_groups(_docs(spark, sf), None).select(
        F.col("row_idx").alias("doc_id"), "duplicate_group", "duplicate_status")


def _named_pages(spark, sf):
    """Programme name and address of every page; the address is its site and its language section."""
    c = _content(spark, sf)
    return c.select(F.col("page_id").alias("row_idx"),
                    X.infer_name(F.col("title"), F.col("heading"), F.col("url"), TEST)["name"].alias("name"),
                    F.regexp_extract("url", r"^([a-z]+://[^/]*(?:/[^/?#]*)?)", 1).alias("url"))


def q_near_dup_difflib(spark, sf):
    return assign_groups(_named_pages(spark, sf), C.DUPLICATE_RATIO).select(
        F.col("row_idx").alias("page_id"), "duplicate_group", "duplicate_status")


def q_warnings(spark, sf):
    return warnings_report(_job(spark, sf, "robots").warnings)


def q_crawl_visits_robots(spark, sf):
    return _job(spark, sf, "robots").visits.select("target_idx", "visit_rank", "depth", "url")


def q_crawl_visits(spark, sf):
    return _job(spark, sf).visits.select("target_idx", "visit_rank", "depth", "url")


def q_crawl_visits_limit4(spark, sf):
    """The limit is the feature: at most four pages per target."""
    return _job(spark, sf, "limit4").visits.select("target_idx", "visit_rank", "depth", "url")


def q_limited_visits(spark, sf):
    """The limits of a polite live crawl are the feature here and in the other ``limited_`` queries."""
    return _job(spark, sf, "limits").visits.select("target_idx", "visit_rank", "depth", "url")


def q_limited_candidates(spark, sf):
    return candidate_report(_job(spark, sf, "limits").candidates)


def q_limited_rows(spark, sf):
    return _job(spark, sf, "limits").programmes.select(*PROG_COLS)


def q_limited_run_log(spark, sf):
    """The run log's text holds the first 20 warnings."""
    return _job(spark, sf, "limits").run_log


def q_targets_csv(spark, sf):
    """Targets read back from CSV files that Spark writes from ``pages``, three of them, in file order."""
    raw = targets_from_pages(_read(spark, sf, "pages"))
    folder = scratch(spark, "targets-csv")
    raw.select(F.col("name").alias("University Name"), F.col("country").alias("Country"), F.col("seed_url").alias("Seed URL"),
               F.when(F.col("target_idx") % 3 == 1, F.lit(" ")).otherwise(F.col("allowed_domain")).alias("Allowed Domain"),
               F.concat(F.lit('a "note", '), F.col("name"), F.lit("\nin two lines")).alias("Notes"), "target_idx") \
        .repartitionByRange(3, "target_idx").sortWithinPartitions("target_idx").drop("target_idx") \
        .write.option("header", True).option("escape", '"').csv(folder)
    return read_targets(spark, folder)


def q_candidates(spark, sf):
    return _job(spark, sf).candidates.select("target_idx", "candidate_rank", "url", "candidate_score", "visit_rank")


def q_candidate_report(spark, sf):
    return candidate_report(_job(spark, sf).candidates)


PROG_COLS = ["row_idx", "target_idx", "university_name", "country", "programme_name", "programme_type",
             "target_students", "language", "duration_period", "programme_dates", "application_deadline",
             "programme_fee", "housing", "credits_certificate", "main_contents", "eligibility", "source_url",
             "source_page_title", "confidence_score", "missing_fields", "review_status", "duplicate_group",
             "duplicate_status", "last_checked", "extraction_method", "notes"]


def q_programmes(spark, sf):
    return _job(spark, sf).programmes.select(*PROG_COLS)


def q_programme_rows(spark, sf):
    return _job(spark, sf, "fallback").programmes.select(*PROG_COLS)


def q_fallback_rows(spark, sf):
    return _job(spark, sf, "fallback").programmes.filter(F.col("extraction_method") == "fallback").select(
        "row_idx", "target_idx", "programme_name", "source_url", "confidence_score", "review_status", "notes")


def q_row_highlight(spark, sf):
    return row_highlight(_job(spark, sf, "fallback").programmes).select("row_idx", "row_highlight", "highlight_colour")


def q_target_summary(spark, sf):
    return _job(spark, sf, "following").summary


def q_run_log(spark, sf):
    return _job(spark, sf).run_log


def q_robots_rules(spark, sf):
    return robots_rules(derived_robots(_read(spark, sf, "pages")), TEST)


def q_robots_gate(spark, sf):
    rules = robots_rules(derived_robots(_read(spark, sf, "pages")), TEST)
    visits = _job(spark, sf, "following").visits.select("target_idx", "url")
    return robots_flag(visits, rules, TEST).select("target_idx", "url", "allowed")


QUERIES = {
    "pages_normalised": q_pages_normalised, "captures": q_captures, "page_text": q_page_text, "page_heading": q_page_heading,
    "page_links": q_page_links, "page_scores": q_page_scores, "url_skip": q_url_skip,
    "frontier_filter": q_frontier_filter, "domain_allowed": q_domain_allowed, "targets_clean": q_targets_clean,
    "pages_per_target": q_pages_per_target, "programme_name": q_programme_name, "first_match": q_first_match,
    "language_flag": q_language_flag, "housing_flag": q_housing_flag, "programme_type": q_programme_type,
    "dup_name_key": q_dup_name_key, "dup_block_key": q_dup_block_key, "near_dup_exact": q_near_dup_exact,
    "near_dup_difflib": q_near_dup_difflib, "crawl_visits": q_crawl_visits, "crawl_visits_limit4": q_crawl_visits_limit4, "crawl_visits_robots": q_crawl_visits_robots, "warnings": q_warnings,
    "candidates": q_candidates, "candidate_report": q_candidate_report, "programmes": q_programmes,
    "programme_rows": q_programme_rows, "fallback_rows": q_fallback_rows, "row_highlight": q_row_highlight,
    "target_summary": q_target_summary, "run_log": q_run_log, "robots_rules": q_robots_rules,
    "robots_gate": q_robots_gate, "limited_visits": q_limited_visits, "limited_candidates": q_limited_candidates,
    "limited_rows": q_limited_rows, "limited_run_log": q_limited_run_log, "targets_csv": q_targets_csv,
    "page_scores_lexicon": q_page_scores_lexicon,
}
