"""Helpers shared by the corpus operators: staging, row keys, connected components."""
from __future__ import annotations

import ctypes
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import member_test, scratch, staged

__all__ = ["bitmap", "components", "crc_mod", "frames", "fresh", "member_test", "mix64", "read", "runs", "scratch", "sorted_groups",
           "staged", "text_of", "trim"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, applied to every element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs(sizes, most: int):
    """Slices of consecutive items whose sizes sum up to about ``most``."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def bitmap(slots: DataFrame, bits: int) -> np.ndarray:
    """One bit for each number below ``2**bits`` in the column ``slot``: ``2**bits / 8`` bytes at any size."""
    slot = F.col("slot") + 1  # buckets count from 1, each of 32768 bits
    rows = slots.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")) \
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["b"] - 1) * 4096
        out[at:at + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def sorted_groups(batches, keys: int):
    """``(key, rows)`` of rows that arrive sorted by their first ``keys`` columns, in batches."""
    def rows():
        for b in batches:
            yield from zip(*(b[c].tolist() for c in b.columns))
    return groupby(rows(), key=lambda r: r[:keys])


def frames(rows, columns: list[str], size: int = 2000):
    """Frames of ``size`` rows each."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def trim() -> None:
    """Give freed memory back to the system, as a worker that is kept for later tasks would hold its peak."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Connected components of undirected ``edges(a, b)`` -> ``(id, component)``.

    ``component`` is the smallest id of the component; ids without an edge to
    another id are absent.  Alternates the large-star and small-star steps
    (every step is a grouped minimum and one join), so a hub or a long chain
    needs a logarithmic number of rounds and no vertex is gathered in one task.
    """
    pairs = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        pairs = staged(small, "edges")
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    out = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct())
