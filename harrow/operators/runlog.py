"""Run summary: per-target counts, run counters, first warnings, status."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MiningConfig


def target_summary(targets: DataFrame, visits: DataFrame, cands: DataFrame, rows: DataFrame) -> DataFrame:
    """Per target: pages visited, candidate pages, programme rows."""
    v = visits.groupBy("target_idx").agg(F.count(F.lit(1)).alias("pages_visited"))
    c = cands.groupBy("target_idx").agg(F.count(F.lit(1)).alias("candidate_pages"))
    r = rows.groupBy("target_idx").agg(F.count(F.lit(1)).alias("programme_rows"),
                                       F.sum((F.col("extraction_method") == "fallback").cast("int")).alias("fallback_rows"))
    return targets.select("target_idx", F.col("name").alias("university_name")) \
        .join(v, "target_idx", "left").join(c, "target_idx", "left").join(r, "target_idx", "left") \
        .fillna(0, ["pages_visited", "candidate_pages", "programme_rows", "fallback_rows"])


def warnings_text(warnings: DataFrame, keep: int | None) -> DataFrame:
    """``n_warnings`` and their text for the run log.

    With ``keep``, the first ones in (target, phase, rank) order, ' | '-joined:
    ``orderBy().limit()`` is a per-partition top-k followed by a merge, so only
    ``keep`` rows per partition ever move.  Without, the text says how many
    there are; all of them are in the warnings table.
    """
    n = warnings.agg(F.count(F.lit(1)).alias("n_warnings"))
    if keep is None:
        return n.withColumn("warnings", F.when(F.col("n_warnings") > 0, F.concat(F.col("n_warnings"), F.lit(" in the warnings table")))
                            .otherwise(F.lit("")))
    first = warnings.orderBy("target_idx", "phase", "rank").limit(keep)
    return _side_by_side(n, first.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("target_idx", "phase", "rank", "text"))), lambda s: s["text"]), " | ").alias("warnings")))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join two one-row frames on a constant key."""
    return a.withColumn("_one", F.lit(1)).join(b.withColumn("_one", F.lit(1)), "_one").drop("_one")


def run_log(targets: DataFrame, visits: DataFrame, cands: DataFrame, reads: DataFrame, rows: DataFrame,
            warnings: DataFrame, cfg: MiningConfig, start_ts: Column, end_ts: Column, error: str = "") -> DataFrame:
    """One-row run log with the counters of the reference report.

    ``reads`` has one row per candidate with ``read_ok`` (second read did not
    fail); ``rows`` are the programme rows after duplicate marking; ``error``
    is what ended the run early, if anything did.
    """
    fmt = "yyyy-MM-dd HH:mm:ss 'UTC'"
    t = targets.agg(F.count(F.lit(1)).alias("universities_processed"))
    v = visits.agg(F.count(F.lit(1)).alias("total_pages_visited"))
    c = cands.agg(F.count_distinct("target_idx").alias("universities_with_candidates"),
                  F.count(F.lit(1)).alias("total_candidate_pages"))
    rd = reads.agg(F.coalesce(F.sum(F.col("read_ok").cast("long")), F.lit(0)).alias("candidate_pages_read"))
    r = rows.agg(
        F.count_distinct("target_idx").alias("universities_with_extracted_programmes"),
        F.count(F.lit(1)).alias("total_programme_rows"),
        F.coalesce(F.sum((F.col("extraction_method") == "fallback").cast("long")), F.lit(0)).alias("fallback_rows"),
        F.coalesce(F.sum((F.col("duplicate_status") == "Duplicate").cast("long")), F.lit(0)).alias("duplicate_rows"))
    w = warnings_text(warnings, cfg.warnings_kept)
    # Six one-row aggregates side by side (each is a single global row).
    out = t
    for part in (v, c, rd, r, w):
        out = _side_by_side(out, part)
    return out.select(
        F.date_format(start_ts, fmt).alias("start_time"),
        F.date_format(end_ts, fmt).alias("end_time"),
        *[F.col(c).cast("long").alias(c) for c in [
            "universities_processed", "universities_with_candidates", "universities_with_extracted_programmes",
            "total_pages_visited", "total_candidate_pages", "candidate_pages_read", "total_programme_rows",
            "fallback_rows", "duplicate_rows"]],
        F.when(F.lit(error != ""), F.lit("Failed")).when(F.col("n_warnings") > 0, F.lit("Completed with warnings"))
        .otherwise(F.lit("Completed")).alias("status"),
        F.coalesce(F.col("warnings"), F.lit("")).alias("warnings"),
        F.lit(error).alias("errors"),
    )
