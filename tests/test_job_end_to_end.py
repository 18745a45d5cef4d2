"""The whole job on a small hand-made site: statuses, content types, robots, fallback."""
import datetime as dt
import os

from pyspark.sql import functions as F

from harrow.config import DEFAULT
from harrow.plans.job import run_job
from harrow.sources.targets import clean_targets

SUMMER = ("<html><head><title>Summer Programme | Example University</title></head><body>"
          "<h1>Summer Programme - Example University</h1><p>Programme Fee: JPY 1,000. Application Deadline: May 1."
          " Eligibility: undergraduates. Housing is provided.</p><a href='/exchange-program'>x</a>"
          "<a href='/private/secret'>p</a><a href='/missing'>m</a><a href='/doc.pdf'>d</a>"
          "<a href='https://other.test/summer'>o</a></body></html>")
HOME = ("<html><head><title>Home</title></head><body><a href='/summer'>s</a><a href='/news'>n</a>"
        "<a href='/contact'>c</a><a href='/img.png'>i</a></body></html>")
EXCHANGE = "<html><head><title>Exchange program</title></head><body><p>exchange program study abroad</p></body></html>"


def test_job_statuses_robots_and_counters(spark):
    targets = clean_targets(spark.createDataFrame(
        [(0, "Example University", "Testland", "https://www.example.test/", "", "")],
        "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"))
    pages = spark.createDataFrame([
        (1, "https://www.example.test/", HOME, 200, "text/html; charset=utf-8", None),
        (2, "https://www.example.test/summer#top", SUMMER, 200, "text/html", None),
        (3, "https://www.example.test/news", "<p>news</p>", 404, "text/html", "404 Client Error"),
        (4, "https://www.example.test/exchange-program", EXCHANGE, 200, "text/html", None),
        (5, "https://www.example.test/doc.pdf", "%PDF", 200, "application/pdf", None),
        (6, "https://www.example.test/private/secret", SUMMER, 200, "text/html", None),
    ], "page_id long, url string, html string, status int, content_type string, error string")
    robots = spark.createDataFrame([(0, 200, "User-agent: *\nDisallow: /private\n")],
                                   "target_idx long, status int, body string")
    r = run_job(targets, pages, DEFAULT, robots=robots, run_ts=dt.datetime(2026, 1, 1), end_ts=dt.datetime(2026, 1, 1))
    visits = {v.url: (v.visit_rank, v.depth) for v in r.visits.collect()}
    # seed, then its links in sorted order (contact/png skipped), then the summer page's links
    # ('.pdf' is not on the skip list: visited, non-HTML, no content, no warning)
    assert visits == {
        "https://www.example.test": (1, 0),
        "https://www.example.test/news": (2, 1),
        "https://www.example.test/summer": (3, 1),
        "https://www.example.test/doc.pdf": (4, 2),
        "https://www.example.test/exchange-program": (5, 2),
        "https://www.example.test/missing": (6, 2),
        "https://www.example.test/private/secret": (7, 2),
    }
    cands = {c.url: (c.candidate_rank, c.candidate_score) for c in r.candidates.collect()}
    assert set(cands) == {"https://www.example.test/summer", "https://www.example.test/exchange-program"}
    rows = {p.source_url: p for p in r.programmes.collect()}
    summer = rows["https://www.example.test/summer"]
    assert summer.programme_name == "Summer Programme"
    assert summer.programme_fee == "JPY 1,000"
    assert summer.application_deadline == "May 1"
    assert summer.housing == "Available"
    assert summer.extraction_method == "heuristic"
    log = r.run_log.collect()[0]
    assert log.total_pages_visited == 7
    assert log.total_candidate_pages == 2
    assert log.status == "Completed with warnings"
    assert [w.text for w in r.warnings.orderBy("target_idx", "phase", "rank").collect()] == [
        "Example University: https://www.example.test/news: 404 Client Error",
        "Example University: https://www.example.test/missing: page not captured"]


def test_job_fallback_with_separate_detail_read(spark):
    targets = clean_targets(spark.createDataFrame(
        [(0, "Example University", "Testland", "https://example.test/summer-programme", "example.test", "")],
        "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"))
    pages = spark.createDataFrame([(1, "https://example.test/summer-programme", SUMMER)],
                                  "page_id long, url string, html string")
    detail = spark.createDataFrame([(1, "https://example.test/summer-programme", "")],
                                   "page_id long, url string, html string")
    r = run_job(targets, pages, DEFAULT, detail_pages=detail, run_ts=dt.datetime(2026, 1, 1))
    rows = r.programmes.collect()
    assert len(rows) == 1
    assert rows[0].extraction_method == "fallback"
    assert rows[0].programme_name == "Summer Programme"
    assert rows[0].confidence_score <= 45
    log = r.run_log.collect()[0]
    assert log.fallback_rows == 1 and log.candidate_pages_read == 1


def test_second_read_parses_candidates_and_outcomes_hold_no_texts(spark):
    targets = clean_targets(spark.createDataFrame(
        [(0, "Example University", "Testland", "https://www.example.test/", "", "")],
        "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"))
    rows = [(1, "https://www.example.test/", HOME), (2, "https://www.example.test/summer", SUMMER),
            *[(10 + i, f"https://www.example.test/other/{i}", "<p>other</p>") for i in range(20)]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    detail = pages.withColumn("html", F.concat("html", F.lit("<p>Duration: 3 weeks.</p>")))
    r = run_job(targets, pages, DEFAULT, detail_pages=detail)
    assert [c.url for c in r.candidates.collect()] == ["https://www.example.test/summer"]
    assert [p.duration_period for p in r.programmes.collect()] == ["3 weeks"]
    parsed = sorted(spark.read.parquet(f"{r.scope.folder}/{d}").count() for d in os.listdir(r.scope.folder) if d.startswith("content-"))
    assert parsed == [1, 22]
    assert not {"text", "heading", "links"} & set(r.outcomes.columns)
    r.scope.delete()
