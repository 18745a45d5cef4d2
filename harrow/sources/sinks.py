"""Report projections and writers for the three output tables."""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.staging import RunScope, hadoop_path

_PROGRAMME_FIELDS = [
    "university_name", "country", "programme_name", "programme_type", "target_students", "language",
    "duration_period", "programme_dates", "application_deadline", "programme_fee", "housing",
    "credits_certificate", "main_contents", "eligibility", "source_url", "source_page_title",
    "confidence_score", "missing_fields", "review_status", "duplicate_group", "duplicate_status",
    "last_checked", "extraction_method", "notes",
]
_CANDIDATE_FIELDS = ["university_name", "country", "url", "page_title", "candidate_score",
                     "matched_keywords", "candidate_type", "reason", "needs_review"]
_RUNLOG_FIELDS = ["start_time", "end_time", "universities_processed", "universities_with_candidates",
                  "universities_with_extracted_programmes", "total_pages_visited", "total_candidate_pages",
                  "candidate_pages_read", "total_programme_rows", "fallback_rows", "duplicate_rows",
                  "status", "warnings", "errors"]


def candidate_report(cands: DataFrame, headings: bool = False) -> DataFrame:
    """Candidate table in report order; keywords rendered ', '-joined."""
    out = cands.withColumn("matched_keywords", F.array_join("matched_keywords", ", "))
    cols = [F.col(c) for c in _CANDIDATE_FIELDS]
    if headings:
        cols = [F.col(c).alias(h) for c, h in zip(_CANDIDATE_FIELDS, C.CANDIDATE_COLUMNS)]
    return out.select("target_idx", "candidate_rank", *cols)


def row_highlight(rows: DataFrame) -> DataFrame:
    """Highlight class and colour: Duplicate beats the review status."""
    cls = F.when(F.col("duplicate_status") == "Duplicate", F.lit("Duplicate")).otherwise(F.col("review_status"))
    colour = F.lit(None).cast("string")
    for name, hexcode in C.HIGHLIGHT_COLOURS:
        colour = F.when(cls == name, F.lit(hexcode)).otherwise(colour)
    return rows.withColumn("row_highlight", F.when(colour.isNotNull(), cls)).withColumn("highlight_colour", colour)


def programme_report(rows: DataFrame, headings: bool = False) -> DataFrame:
    cols = [F.col(c) for c in _PROGRAMME_FIELDS]
    if headings:
        cols = [F.col(c).alias(h) for c, h in zip(_PROGRAMME_FIELDS, C.PROGRAMME_COLUMNS)]
    return rows.select("row_idx", *cols)


def run_log_report(log: DataFrame, headings: bool = False) -> DataFrame:
    if not headings:
        return log.select(*_RUNLOG_FIELDS)
    return log.select(*[F.col(c).alias(h) for c, h in zip(_RUNLOG_FIELDS, C.RUN_LOG_COLUMNS)])


def warnings_report(warnings: DataFrame) -> DataFrame:
    """Every warning, in the order target, phase (0 seed, 1 crawl, 2 extraction), rank."""
    return warnings.select("target_idx", "phase", F.col("rank").cast("long").alias("rank"), "text")


RUNS, MANIFEST = "_runs", "_manifest-"


def write_reports(reports: dict, out_dir: str, fmt: str = "parquet", run: RunScope | None = None) -> None:
    """Write the report tables as one set (empty tables still get their schema/header).

    All tables are written below ``_runs/<id>`` first.  Then a manifest that names
    the run and its tables gets the next number by one rename, which is the commit:
    before it ``read_report`` gives the old tables, after it the new ones.  Last, the
    tables move to ``<out_dir>/<name>``, for readers of plain folders; a writer that
    was lost before or while they moved is caught up with by the next one.  With ``run``, the
    run's intermediate tables are deleted at the end.
    """
    spark = next(iter(reports.values())).sparkSession
    _settle(spark, out_dir)
    run_id = uuid.uuid4().hex
    for name, df in reports.items():
        w = df.write.mode("overwrite")
        if fmt == "csv":
            w = w.option("header", True)
        w.format(fmt).save(f"{out_dir}/{RUNS}/{run_id}/{name}")
    store, fresh = hadoop_path(spark, f"{out_dir}/{RUNS}/{run_id}/{MANIFEST}")
    out = store.create(fresh, True)
    out.write(bytearray(json.dumps({"run": run_id, "format": fmt, "tables": list(reports)}).encode()))
    out.close()
    last = max((n for n, _ in _manifests(spark, out_dir)), default=0)
    if not store.rename(fresh, hadoop_path(spark, f"{out_dir}/{MANIFEST}{last + 1:010d}")[1]):
        raise OSError(f"the reports of {out_dir} could not be committed")
    _settle(spark, out_dir)
    if run is not None:
        run.delete()


def _manifests(spark, out_dir: str) -> list:
    """``(number, path)`` of the manifests; the highest number counts."""
    store, folder = hadoop_path(spark, out_dir)
    names = [f.getPath() for f in store.listStatus(folder)] if store.exists(folder) else []
    return [(int(p.getName()[len(MANIFEST):]), p) for p in names if p.getName().startswith(MANIFEST)]


def _manifest(spark, out_dir: str) -> dict | None:
    number, path = max(_manifests(spark, out_dir), key=lambda m: m[0], default=(0, None))
    if path is None:
        return None
    stream = hadoop_path(spark, out_dir)[0].open(path)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _settle(spark, out_dir: str) -> None:
    """Move the committed run's tables into place and drop what uncommitted runs left."""
    found = _manifest(spark, out_dir)
    store, runs = hadoop_path(spark, f"{out_dir}/{RUNS}")
    for name in found["tables"] if found else ():
        source, target = (hadoop_path(spark, f"{out_dir}/{x}")[1] for x in (f"{RUNS}/{found['run']}/{name}", name))
        if store.exists(source):
            store.delete(target, True)
            if not store.rename(source, target):
                raise OSError(f"{source.toString()} could not be moved to {target.toString()}")
    store.delete(runs, True)
    for _, path in sorted(_manifests(spark, out_dir), key=lambda m: m[0])[:-1]:
        store.delete(path, False)


def read_report(spark, out_dir: str, name: str) -> DataFrame:
    """A table of the last run that was written whole."""
    found = _manifest(spark, out_dir)
    if found is None or name not in found["tables"]:
        raise ValueError(f"{out_dir} holds no written report {name}")
    moved = f"{out_dir}/{name}"
    store, waiting = hadoop_path(spark, f"{out_dir}/{RUNS}/{found['run']}/{name}")
    return spark.read.option("header", True).format(found["format"]).load(waiting.toString() if store.exists(waiting) else moved)
