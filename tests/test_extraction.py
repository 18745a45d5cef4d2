"""Extraction, duplicates, fallback rows, the run log and bad input on pages of our own."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from harrow.config import CRAWL_LIMITS, DEFAULT
from harrow.operators.extract import first_match, infer_name
from harrow.plans.job import run_job
from harrow.sources.sinks import candidate_report, programme_report, run_log_report, warnings_report, write_reports
from harrow.sources.targets import clean_targets, read_targets

SITE = "https://north.example"
COURSE = """<html><head><title>Winter Language Weeks - International Office</title></head><body><h1>Winter Language Weeks</h1>
<ul><li>Programme Dates: 3 February to 28 February 2027; all days.</li><li>Application Deadline: 1 November 2026.</li>
<li>Programme fee: EUR 950.</li><li>Duration: four weeks.</li><li>Credits: 6 ECTS.</li></ul><p>A short-term program in German.
Students live in a dormitory.</p><p>Eligibility: level A2 or above</p></body></html>"""
HOME = "<title>Home</title><a href='/short/winter'>w</a><a href='/short/winter-copy'>c</a><a href='/news/archive'>n</a>"
TARGET_SCHEMA = "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"
RUN = dt.datetime(2026, 10, 5, 8, 30)


def targets(spark, *rows):
    return clean_targets(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TARGET_SCHEMA))


_DONE: dict = {}


def job(spark, pages, *rows, **options):
    """A run over ``(url, html)`` pages; equal runs without tables of their own are made once."""
    key = (spark.sparkContext.applicationId, repr((pages, rows, sorted(options.items(), key=str))))
    if "detail_pages" in options:
        return _run(spark, pages, *rows, **options)
    if key not in _DONE:
        _DONE[key] = _run(spark, pages, *rows, **options)
    return _DONE[key]


def _run(spark, pages, *rows, **options):
    rows = rows or (("North College", "Norland", f"{SITE}/", "", ""),)
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return run_job(targets(spark, *rows), df, options.pop("cfg", DEFAULT), run_ts=RUN, end_ts=RUN, **options)


PAGES = [(f"{SITE}", HOME), (f"{SITE}/short/winter", COURSE), (f"{SITE}/short/winter/", COURSE), (f"{SITE}/short/winter-copy", COURSE)]


def test_fields_of_a_course_page(spark):
    rows = {r["source_url"]: r for r in job(spark, PAGES).programmes.collect()}
    row = rows[f"{SITE}/short/winter"]
    want = {
        "programme_name": "Winter Language Weeks", "programme_dates": "3 February to 28 February 2027", "application_deadline": "1 November 2026",
        "programme_fee": "EUR 950", "duration_period": "four weeks", "credits_certificate": "6 ECTS", "housing": "Available",
        "eligibility": "level A2 or above", "missing_fields": "", "extraction_method": "heuristic", "review_status": "Likely valid", "notes": "",
        "last_checked": "2026-10-05", "source_page_title": "Winter Language Weeks - International Office", "university_name": "North College",
    }
    assert {k: row[k] for k in want} == want
    # The copy lies at another address, so it is a programme of its own.
    assert {r["duplicate_status"] for r in rows.values()} == {"Unique"}


def test_repeated_candidates_are_duplicates(spark):
    two = (("North College", "Norland", f"{SITE}/", "", ""), ("North College again", "Norland", f"{SITE}/short/winter", "", ""))
    got = job(spark, PAGES, *two)
    rows = [r for r in got.programmes.orderBy("row_idx").collect() if r["source_url"].endswith("/winter")]
    assert [(r["duplicate_status"], r["duplicate_group"]) for r in rows] == [("Primary", rows[0]["duplicate_group"]), ("Duplicate", rows[0]["duplicate_group"])]
    assert rows[0]["duplicate_group"].startswith("DUP-00") and rows[1]["review_status"] == "Needs human review"
    log = got.run_log.first()
    assert log["duplicate_rows"] == 1 and log["total_programme_rows"] == 3 and log["universities_processed"] == 2
    assert log["start_time"] == "2026-10-05 08:30:00 UTC"


def test_an_empty_second_read_gives_fallback_rows(spark):
    empty = spark.createDataFrame([(i, u, "") for i, (u, _) in enumerate(PAGES)], "page_id long, url string, html string")
    rows = job(spark, PAGES, detail_pages=empty).programmes.collect()
    assert len(rows) == 2
    for r in rows:
        assert r["extraction_method"] == "fallback" and r["review_status"] == "Needs human review" and r["confidence_score"] == 45
        assert r["missing_fields"] == "Programme Dates, Application Deadline, Programme Fee, Housing, Eligibility"
        assert r["programme_name"] == "Winter Language Weeks" and r["programme_fee"] == "Unknown"
    one = job(spark, PAGES, detail_pages=empty, cfg=DEFAULT.with_(fallback_top=1)).programmes.count()
    assert one == 1


def test_limits_are_off_unless_asked_for(spark):
    long = "word " * 4000
    df = spark.createDataFrame([("x" * 700,)], "t string")
    assert len(df.select(first_match(F.col("t"), ["(x+)"])).first()[0]) == 700
    assert len(df.select(first_match(F.col("t"), ["(x+)"], 500)).first()[0]) == 500
    name = df.select(infer_name(F.col("t"), F.lit(""), F.lit(""), DEFAULT)["name"]).first()[0]
    assert len(name) == 700
    assert len(df.select(infer_name(F.col("t"), F.lit(""), F.lit(""), DEFAULT.with_(**CRAWL_LIMITS))["name"]).first()[0]) == 200
    late = [(SITE, f"<p>{long}</p><p>summer program, housing, eligibility</p>")]
    assert job(spark, late).candidates.count() == 1
    assert job(spark, late, cfg=DEFAULT.with_(**CRAWL_LIMITS)).candidates.count() == 0
    many = [(SITE, "".join(f"<a href='/program{i:03d}'>x</a>" for i in range(80)))]
    assert job(spark, many).visits.count() == 81
    few = job(spark, many, cfg=DEFAULT.with_(**CRAWL_LIMITS))
    assert few.visits.count() == 50
    assert few.run_log.first()["warnings"].count(" | ") == 19 and few.warnings.count() == 49


BAD = (("North College", "Norland", f"{SITE}/", "", ""), ("Broken", "Norland", "https://[north/", "", ""), ("Away", "Norland", "https://far.example/", "near.example", ""),
       ("Last", "Norland", f"{SITE}/short/winter", "", ""))


def test_targets_that_cannot_be_visited_leave_a_warning(spark):
    got = job(spark, PAGES, *BAD)
    log = got.run_log.first()
    assert (log["status"], log["errors"], log["universities_processed"]) == ("Completed with warnings", "", 4)
    seeds = {r["target_idx"]: r["text"] for r in got.warnings.filter("phase = 0").collect()}
    assert set(seeds) == {1, 2} and seeds[1] == "Broken: seed skipped: Invalid IPv6 URL" and "far.example" in seeds[2]
    assert log["warnings"] == f"{got.warnings.count()} in the warnings table"


def test_strict_runs_end_at_a_malformed_target(spark):
    got = job(spark, PAGES, *BAD, strict=True)
    log = got.run_log.first()
    assert (log["status"], log["errors"], log["universities_processed"]) == ("Failed", "Invalid IPv6 URL", 2)
    assert {r["target_idx"] for r in got.programmes.collect()} == {0}
    assert job(spark, PAGES, strict=True).run_log.first()["errors"] == ""


def test_malformed_links(spark):
    pages = [(SITE, HOME), (f"{SITE}/short/winter", COURSE + "<a href='http://[bad/'>x</a><a href='/short/more'>y</a>")]
    kept = job(spark, pages)
    assert f"{SITE}/short/more" in {r["url"] for r in kept.visits.collect()} and kept.programmes.count() == 1
    lost = job(spark, pages, strict=True)
    assert lost.programmes.count() == 0 and lost.run_log.first()["status"] == "Completed with warnings"
    assert f"North College: {SITE}/short/winter: Invalid IPv6 URL" in {r["text"] for r in lost.warnings.collect()}


def test_captures_that_agree_in_address_and_id_count_once(spark):
    twice = spark.createDataFrame([(1, SITE, HOME), (1, SITE, HOME), (2, f"{SITE}/short/winter", COURSE), (2, f"{SITE}/short/winter/", COURSE)],
                                  "page_id long, url string, html string")
    got = run_job(targets(spark, ("N", "N", SITE, "", "")), twice, DEFAULT, run_ts=RUN, end_ts=RUN)
    assert got.content.count() == 2 and got.programmes.count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_reports_are_written_even_when_empty(spark, tmp_path, fmt):
    for name, r in (("full", job(spark, PAGES)), ("empty", job(spark, []))):
        out = f"{tmp_path}/{name}"
        write_reports({"candidates": candidate_report(r.candidates, headings=True), "programmes": programme_report(r.programmes, headings=True),
                       "log": run_log_report(r.run_log, headings=True), "warnings": warnings_report(r.warnings)}, out, fmt)
        read = spark.read.option("header", True).format(fmt).load
        assert read(f"{out}/log").count() == 1
        assert "Programme Name" in read(f"{out}/programmes").columns or name == "empty" and fmt == "csv"
        assert (read(f"{out}/candidates").count() > 0) == (name == "full")
        assert read(f"{out}/warnings").columns[:2] == ["target_idx", "phase"] or fmt == "csv"


def test_bad_input_leaves_no_output(spark, tmp_path):
    book = tmp_path / "targets.xlsx"
    book.write_bytes(b"PK\x03\x04")
    with pytest.raises(ValueError, match="Excel input is not supported yet"):
        read_targets(spark, str(book))
    assert list(tmp_path.iterdir()) == [book]


def test_csv_targets(spark, tmp_path):
    head = "University Name,Country,Seed URL,Allowed Domain,Notes\n"
    path = tmp_path / "t.csv"
    path.write_text("﻿" + head + 'South,Sorland,https://www.south.example/en/,,"two\nlines"\n,,,,\n  \t,,,,\nEast,Estland,https://e.example/, e.example ,x\n'
                    "South,Sorland,https://www.south.example/b,,\n", encoding="utf-8")
    rows = read_targets(spark, str(path)).orderBy("target_idx").collect()
    assert [(r["target_idx"], r["name"], r["allowed_domain"], r["notes"]) for r in rows] == [
        (0, "South", "south.example", "two\nlines"), (1, "East", "e.example", "x"), (2, "South", "south.example", "")]
    for text, message in ((head.replace(",Notes", "") + "A,B,C,D\n", "missing required column"), (head + "A,,,,\n", "must include University Name and Seed URL"),
                          (head + ",,https://x.example,,\n", "must include University Name and Seed URL")):
        bad = tmp_path / "bad.csv"
        bad.write_text(text, encoding="utf-8")
        with pytest.raises(ValueError, match=message):
            read_targets(spark, str(bad))
