"""Targets: the table of sites to explore.

``read_targets`` reads the CSV form (UTF-8, optional BOM, quoted multi-line
fields, header), or a folder of such files in the order of their names.  Columns are bound by header name; validation errors are
raised on the driver before anything is written, with a bounded probe
(``limit(1)``) rather than a collect of the table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INPUT_COLUMNS, MALFORMED
from ..functions.ordinal import bucket_ordinal, range_ordinal
from ..functions.staging import staged
from ..functions.text import ustrip
from ..functions.urls import netloc, normalise_domain, normalise_url, scheme, well_formed

TARGET_SCHEMA = "target_idx long, name string, country string, seed_url string, allowed_domain string, notes string"


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".xlsx"):
        raise ValueError("Please select target_universities.csv. Excel input is not supported yet.")
    raw = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
           .option("encoding", "UTF-8").option("inferSchema", False).csv(path))
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row"))
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    missing = [c for c in INPUT_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} is missing required column(s): {', '.join(missing)}")
    # File order: files by name, rows as they stand.  A file with multi-line fields is read whole by one
    # task, whichever others are with it, and the ids of a task grow by one, from a multiple of 2**33.
    rows = staged(raw, "targets")
    files = range_ordinal(rows.select("_file").distinct(), "_file", "_no").withColumnRenamed("_file", "_name")
    indexed = rows.join(files, rows["_file"] == files["_name"]) \
        .withColumn("_pos", F.col("_no") * F.lit(1 << 33) + F.pmod("_row", F.lit(1 << 33)))
    return clean_targets(indexed.select(
        "_pos",
        F.col("`University Name`").alias("name"), F.col("Country").alias("country"),
        F.col("`Seed URL`").alias("seed_url"), F.col("`Allowed Domain`").alias("allowed_domain"),
        F.col("Notes").alias("notes")), order_col="_pos")


def clean_targets(df: DataFrame, order_col: str = "target_idx", validate: bool = True) -> DataFrame:
    """Trim, drop all-blank rows, reject half-filled rows, default the domain.

    ``target_idx`` is the dense 0-based file position of the kept rows; with an
    existing dense ``target_idx`` it is kept as given.
    """
    t = df.select(
        order_col,
        *[F.coalesce(ustrip(F.col(c)), F.lit("")).alias(c)
          for c in ["name", "country", "seed_url", "allowed_domain", "notes"]])
    t = t.filter((F.col("name") != "") | (F.col("seed_url") != ""))
    if validate and t.filter((F.col("name") == "") | (F.col("seed_url") == "")).limit(1).count() > 0:
        raise ValueError("Each target row must include University Name and Seed URL.")
    t = t.withColumn("allowed_domain", F.when(F.col("allowed_domain") != "", F.col("allowed_domain"))
                     .otherwise(normalise_domain(F.col("seed_url"))))
    if order_col != "target_idx":
        # One read of the file decides the ids, then their order is the file's.
        t = bucket_ordinal(staged(t, "targets"), order_col, "target_idx").withColumn("target_idx", F.col("target_idx") - 1) \
            .drop(order_col)
    return t.select("target_idx", "name", "country", "seed_url", "allowed_domain", "notes")


def targets_from_pages(pages: DataFrame) -> DataFrame:
    """One target per distinct host of the captured pages (seed = min URL).

    Derived from the page table so that the crawl has real work on it.
    """
    keyed = pages.select(F.col("url"), normalise_url(F.col("url")).alias("nurl"))
    keyed = keyed.withColumn("site", F.lower(netloc(F.col("nurl"))))
    per_site = keyed.filter(scheme(F.col("nurl")).isin("http", "https")) \
        .groupBy("site").agg(F.min("url").alias("seed_url"))
    per_site = range_ordinal(per_site, "site", "_ord")
    return per_site.select(
        (F.col("_ord") - 1).alias("target_idx"),
        F.concat(F.lit("Site "), F.col("site")).alias("name"),
        F.lit("Testland").alias("country"),
        F.col("seed_url"),
        normalise_domain(F.col("seed_url")).alias("allowed_domain"),
        F.lit("").alias("notes"),
    )


def seed_faults(targets: DataFrame) -> DataFrame:
    """``(target_idx, fault)`` of targets whose seed cannot be split as a URL (unbalanced brackets in its host)."""
    return targets.filter(~well_formed(normalise_url(F.col("seed_url")))).select("target_idx", F.lit(MALFORMED).alias("fault"))


def target_domains(targets: DataFrame) -> DataFrame:
    return targets.select(normalise_domain(F.col("allowed_domain")).alias("domain")).distinct()
