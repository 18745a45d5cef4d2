"""Score newly captured pages as they land.

Captures arrive as parquet files in a folder (``page_id, url, html``).  The
stream applies the same stateless operators as the batch job (normalise URL,
parse, score) and appends candidate-scored pages to a parquet table; progress
is tracked in the query's checkpoint location, so a restarted or relocated
driver resumes without re-scoring files.  No state store is needed: every
output row depends on its own input row only (duplicates across batches are
resolved by the batch job's first-capture rule when the table is read).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MiningConfig
from ..functions.urls import normalise_url
from ..operators.content import page_content
from ..operators.scoring import score_columns

PAGE_SCHEMA = "page_id long, url string, html string"


def scored_page_stream(spark: SparkSession, capture_dir: str, cfg: MiningConfig,
                       max_files_per_trigger: int = 64) -> DataFrame:
    pages = (spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
             .parquet(capture_dir))
    content = page_content(pages.withColumn("url", normalise_url(F.col("url"))))
    return score_columns(content, cfg).select(
        "page_id", "url", "title", "candidate_score",
        F.array_join("matched_keywords", ", ").alias("matched_keywords"), "candidate_type", "reason")


def start_scoring(spark: SparkSession, capture_dir: str, out_dir: str, checkpoint_dir: str, cfg: MiningConfig,
                  available_now: bool = False):
    """Start the stream; ``available_now`` processes the backlog and stops."""
    writer = (scored_page_stream(spark, capture_dir, cfg).writeStream.format("parquet")
              .option("path", out_dir).option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
