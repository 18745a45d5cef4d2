"""Dense ordinals without a single-partition window.

``row_number()`` over a whole table (or over one huge group) puts every row of
it in one task.  These helpers rank within small pieces and add offsets that
come from a small count table, so no task sees more than one piece.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

FAN = 1 << 16


def _piece(column: str, width: int) -> Column:
    """``floor(column / width)`` in whole numbers."""
    return F.expr(f"(`{column}` - pmod(`{column}`, {width}L)) div {width}L")


def rank_in_pieces(df: DataFrame, group: list[str], piece: list, order: list, out: str) -> DataFrame:
    """1-based rank inside ``group`` by the columns ``piece``, then by ``order``.

    Rows that agree in ``group`` and ``piece`` are ranked in one task, so the
    pieces should be small; offsets are a running sum over the counts of the
    pieces of a group.
    """
    names = [f"_p{i}" for i in range(len(piece))]
    cut = df.withColumns(dict(zip(names, piece)))
    counts = cut.groupBy(*group, *names).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, *names, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    ranked = cut.withColumn("_rn", F.row_number().over(Window.partitionBy(*group, *names).orderBy(*order)))
    return ranked.join(offsets, [*group, *names]).withColumn(out, (F.col("_off") + F.col("_rn")).cast("long")) \
        .drop(*names, "_rn", "_off")


def running_offsets(counts: DataFrame, key: str, value: str, out: str, width: int = FAN) -> DataFrame:
    """Sum of ``value`` over the smaller keys; ``key`` is numeric and unique.

    In three levels: keys inside a lot of ``width`` keys, lots inside a part of
    ``width`` lots, and parts; the single-task sum runs over the parts alone.
    """
    def level(df, k, v, up):
        inside = Window.partitionBy(up).orderBy(k).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("_own", F.coalesce(F.sum(v).over(inside), F.lit(0)))

    rows = counts.withColumn("_lot", _piece(key, width))
    lots = rows.groupBy("_lot").agg(F.sum(value).alias("_pn")).withColumn("_part", _piece("_lot", width))
    parts = lots.groupBy("_part").agg(F.sum("_pn").alias("_tn")).withColumn("_all", F.lit(0))
    part_off = level(parts, "_part", "_tn", "_all").select("_part", F.col("_own").alias("_part_off"))
    lot_off = level(lots, "_lot", "_pn", "_part").join(part_off, "_part") \
        .select("_lot", (F.col("_own") + F.col("_part_off")).alias("_lot_off"))
    return level(rows, key, value, "_lot").join(lot_off, "_lot") \
        .withColumn(out, (F.col("_own") + F.col("_lot_off")).cast("long")).drop("_own", "_lot", "_lot_off")


def bucket_ordinal(df: DataFrame, key: str, out: str, width: int = FAN, group: list[str] | None = None) -> DataFrame:
    """1-based rank of a numeric, unique-per-group ``key`` (within ``group``).

    Pieces are ``(group, floor(key / width))``; each holds at most ``width``
    keys of one group, so even a group with a third of all rows is ranked by
    many tasks.
    """
    piece = _piece(key, width)
    if group:
        return rank_in_pieces(df, group, [piece], [key], out)
    cut = df.withColumn("_bucket", piece)
    counts = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_count"))
    offsets = running_offsets(counts, "_bucket", "_count", "_before", FAN).drop("_count")
    ranked = cut.withColumn("_within", F.row_number().over(Window.partitionBy("_bucket").orderBy(key)))
    return ranked.join(offsets, "_bucket").withColumn(out, (F.col("_before") + F.col("_within")).cast("long")) \
        .drop("_bucket", "_within", "_before")


def grouped_ordinal(df: DataFrame, major: str, minor: str, out: str, width: int = FAN) -> DataFrame:
    """1-based rank over the table by ``(major, minor)``, both numeric and unique together."""
    counts = df.groupBy(major).agg(F.count(F.lit(1)).alias("_count"))
    offsets = running_offsets(counts, major, "_count", "_base").drop("_count")
    ranked = bucket_ordinal(df, minor, "_inner", width, [major])
    return ranked.join(offsets, major).withColumn(out, F.col("_base") + F.col("_inner")).drop("_base", "_inner")


def range_ordinal(df: DataFrame, key: str, out: str, pieces: int | None = None) -> DataFrame:
    """1-based rank of a unique sortable ``key`` (e.g. a string) over the table.

    Range partitioning puts contiguous key ranges in separate partitions; rows
    are ranked inside each range and shifted by the counts of earlier ranges.
    The split samples its boundaries anew each time that it is planned, so it
    is written once, and counts and ranks both read what was written.
    """
    n = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(n, key).withColumn("_piece", F.spark_partition_id().cast("long")), "ranged")
    counts = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_count"))
    offsets = running_offsets(counts, "_piece", "_count", "_before").drop("_count")
    ranked = ranged.withColumn("_within", F.row_number().over(Window.partitionBy("_piece").orderBy(key)))
    return ranked.join(offsets, "_piece").withColumn(out, (F.col("_before") + F.col("_within")).cast("long")) \
        .drop("_piece", "_within", "_before")
