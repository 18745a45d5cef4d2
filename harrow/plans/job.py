"""The whole mining job: targets + captured pages -> report tables.

    targets ──► domains ─┐
    pages ──► scope (narrow keys, bitmap) ─► parse HTML where read ─► score ─► [write]
                                                             │
    robots ─► rules ─────────────► crawl (3 unrolled levels) ┤
                                                             ▼
             visits ─► outcomes ─► candidates ─► detail read ─► programme rows
                                                   fallback rows ─┘   │
                                                  duplicate marking ◄─┘
                                                        ▼
                                   candidate / programme / warnings / run-log tables

Every arrow is a DataFrame transformation; the only Python worker code is the
similarity scan inside duplicate marking.
"""
from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, MALFORMED, MiningConfig
from ..functions.ordinal import grouped_ordinal
from ..functions.staging import RunScope, staged
from ..operators.content import page_content
from ..operators.crawl import candidates as rank_candidates
from ..operators.crawl import crawl_visits, visit_outcomes
from ..operators.dedupe import mark_duplicates
from ..operators.extract import PROGRAMME_OUT, extract_programmes, fallback_rows
from ..operators.runlog import run_log, target_summary
from ..operators.scoring import score_pages
from ..sources.pages import pages_normalised
from ..sources.robots import robots_flag, robots_rules
from ..sources.targets import seed_faults, target_domains


@dataclass
class JobResult:
    content: DataFrame
    visits: DataFrame
    outcomes: DataFrame
    candidates: DataFrame
    reads: DataFrame
    programme_rows: DataFrame
    programmes: DataFrame
    warnings: DataFrame
    run_log: DataFrame
    summary: DataFrame
    #: The run's intermediate tables, which all of the above read; ``scope.delete()`` when they are written.
    scope: RunScope | None = None


def parsed_content(pages: DataFrame, targets: DataFrame | None, cfg: MiningConfig, with_links: bool = True,
                   persist: bool = True, urls: DataFrame | None = None) -> DataFrame:
    """Normalised, in-scope, parsed and scored pages (one row per URL).

    The parse runs where the pages are read, on the rows that may count; only
    its result is shuffled.  It feeds every crawl level, the detail read and the
    reports, so it is written once to the shared folder, in columns: a crawl
    level reads URLs and links alone, and a lost executor never re-parses HTML.
    With ``urls`` only these pages are parsed.
    """
    domains = target_domains(targets) if targets is not None else None
    content = score_pages(pages_normalised(pages, domains, lambda p: page_content(p, with_links), urls), cfg, "url")
    return staged(content, "content") if persist else content


def detail_reads(cands: DataFrame, detail: DataFrame, rules: DataFrame | None, cfg: MiningConfig) -> DataFrame:
    """Second read of each candidate: ``read_ok`` and the detail page columns."""
    base = cands
    if rules is not None:
        base = robots_flag(base, rules, cfg)
    else:
        base = base.withColumn("allowed", F.lit(True))
    d = detail.select("url", F.col("page_id").alias("_dpid"), F.col("failure").alias("_dfail"),
                      F.col("is_html").alias("_dhtml"), F.col("has_html").alias("_dhas"),
                      F.col("title").alias("detail_title"), F.col("heading").alias("detail_heading"),
                      F.col("text").alias("detail_text"))
    j = base.join(d, "url", "left")
    captured = F.col("_dpid").isNotNull()
    failed = F.col("allowed") & (~captured | F.col("_dfail").isNotNull())
    return j.withColumn("read_ok", ~failed) \
        .withColumn("read_failure", F.when(failed, F.coalesce(F.col("_dfail"), F.lit("page not captured")))) \
        .withColumn("detail_has_html", F.col("allowed") & captured & F.coalesce(F.col("_dhtml"), F.lit(False))
                    & F.coalesce(F.col("_dhas"), F.lit(False)) & ~failed) \
        .drop("_dpid", "_dfail", "_dhtml", "_dhas", "allowed")


def run_job(targets: DataFrame, pages: DataFrame, cfg: MiningConfig = DEFAULT, *,
            robots: DataFrame | None = None, detail_pages: DataFrame | None = None,
            edges: DataFrame | None = None, run_ts: _dt.datetime | None = None,
            end_ts: _dt.datetime | None = None, similarity: bool = True, checkpoint: bool = True,
            strict: bool = False) -> JobResult:
    """Run the mining job; ``targets`` as from :mod:`harrow.sources.targets`.

    A target whose seed URL is malformed is skipped with a warning.  With
    ``strict`` it ends the run instead: targets before it are processed, the run
    log says ``Failed`` and why, and the tables hold what was found until then.
    A malformed link is left out; with ``strict`` its page counts as a failed read.
    """
    with RunScope(pages.sparkSession) as scope:
        result = _run(targets, pages, cfg, robots, detail_pages, edges, run_ts, end_ts, similarity, checkpoint, strict)
    result.scope = scope
    return result


def _run(targets, pages, cfg, robots, detail_pages, edges, run_ts, end_ts, similarity, checkpoint, strict) -> JobResult:
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    start = F.lit(run_ts).cast("timestamp")
    run_date = F.date_format(start, "yyyy-MM-dd")
    # Tables that several stages read are written once to the shared folder.
    cp = (lambda df, name: staged(df, name)) if checkpoint else (lambda df, name: df)
    targets = cp(targets, "targets")
    faults = cp(seed_faults(targets), "faults")
    error = ""
    tried = targets
    if strict:
        first = faults.orderBy("target_idx").limit(1).collect()
        if first:
            error = first[0]["fault"]
            tried = targets.filter(F.col("target_idx") <= first[0]["target_idx"])
    good = tried.join(faults, "target_idx", "left_anti")
    content = parsed_content(pages, good, cfg)
    if strict:
        # A page with a malformed link is lost as a failed read.
        content = content.withColumn("failure", F.when(F.col("is_html") & F.col("bad_link"), F.lit(MALFORMED)).otherwise(F.col("failure"))) \
            .withColumn("is_html", F.col("is_html") & ~F.col("bad_link"))
    rules = cp(robots_rules(robots, cfg), "rules") if robots is not None else None
    visits = crawl_visits(good, content, cfg, edges=edges, robots=rules, checkpoint=checkpoint)
    # Texts stay in the content: an outcome is what became of a visit.
    outcomes = cp(visit_outcomes(visits, content.drop("links", "heading", "text"), rules, cfg), "outcomes")
    cands = cp(rank_candidates(outcomes, good, cfg).select(
        "target_idx", "university_name", "country", "url", F.col("title").alias("page_title"),
        "candidate_score", "matched_keywords", "candidate_type", "reason", "needs_review", "visit_rank",
        "candidate_rank"), "candidates")
    if detail_pages is None:
        detail = content
    else:
        # The second read is that of the candidates; other pages of ``detail_pages`` are not parsed.
        detail = parsed_content(detail_pages, good, cfg, with_links=False, urls=cands)
    reads = cp(detail_reads(cands, detail, rules, cfg), "reads")
    heur = cp(extract_programmes(reads, cfg, run_date), "extracted")
    fb = fallback_rows(cands, heur, cfg, run_date)
    rows = cp(grouped_ordinal(heur.unionByName(fb), "target_idx", "candidate_rank", "row_idx"), "rows")
    marked = cp(mark_duplicates(rows, cfg.duplicate_ratio if similarity else None), "programmes")
    names = targets.select("target_idx", F.col("name").alias("_tname"))

    def warning(df, phase, rank, *text):
        return df.join(names, "target_idx").select(
            "target_idx", F.lit(phase).alias("phase"), F.col(rank).cast("int").alias("rank") if isinstance(rank, str) else F.lit(rank).alias("rank"),
            F.concat(F.col("_tname"), *text).alias("text"))

    crawl_warn = warning(outcomes.filter(F.col("failure").isNotNull()), 1, "visit_rank", F.lit(": "), F.col("failure"))
    read_warn = warning(reads.filter(~F.col("read_ok")), 2, "candidate_rank", F.lit(": extraction failed for "),
                        F.col("url"), F.lit(": "), F.col("read_failure"))
    warnings = crawl_warn.unionByName(read_warn)
    if not strict:
        unvisited = good.join(visits.filter("depth = 0").select("target_idx"), "target_idx", "left_anti")
        warnings = warnings.unionByName(warning(faults, 0, 0, F.lit(": seed skipped: "), F.col("fault"))) \
            .unionByName(warning(unvisited.select("target_idx", "seed_url"), 0, 0,
                                 F.lit(": seed skipped: "), F.col("seed_url"), F.lit(" is not in the allowed domain or is on the skip list")))
    warnings = cp(warnings, "warnings")
    end = F.lit(end_ts).cast("timestamp") if end_ts is not None else F.current_timestamp()
    log = run_log(tried, visits, cands, reads, marked, warnings, cfg, start, end, error)
    summary = target_summary(tried, visits, cands, marked)
    return JobResult(content, visits, outcomes, cands, reads, rows, marked.select("row_idx", *PROGRAMME_OUT),
                     warnings, log, summary)
