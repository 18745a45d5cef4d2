"""Intermediate tables on shared storage, size checks, and membership tests ahead of shuffles."""
from __future__ import annotations

import uuid
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


class RunScope:
    """The intermediate tables of one run, below a folder of their own that can be deleted at once.

    Tables staged inside ``with scope:`` belong to it.  Results of a run are
    read lazily from them, so ``delete()`` comes when what is wanted of it is written.
    """

    _current: ContextVar = ContextVar("harrow_run", default=None)

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"

    def __enter__(self) -> "RunScope":
        self._before = self._current.set(self)
        return self

    def __exit__(self, *exc) -> None:
        self._current.reset(self._before)

    def delete(self) -> None:
        store, path = hadoop_path(self.spark, self.folder)
        store.delete(path, True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system that Spark uses for a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, or below that of the run."""
    run = RunScope._current.get()
    base = run.folder if run is not None else ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, but stays columnar, so later reads take
    only the columns that they use.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows; reads no more than that of each partition."""
    return df.limit(rows + 1).count() <= rows


def with_membership(df: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column, out: str, bits: int = 26) -> DataFrame:
    """``df`` with a boolean: whether its 64-bit hash may be among those of ``keys``; ``df`` isn't shuffled.

    The bitmap aggregates set one bit for each hash modulo ``2**bits``; the
    bitmaps, at most ``2**bits / 8`` bytes (8 MB) at any size, are joined to the
    rows by their number.  It is true for every key, and for some others when
    there are very many keys, so an exact join has to follow.
    """
    taken = {c.lower() for c in df.columns}
    tail = next(t for t in ("_" * n for n in range(len(taken) + 1)) if not {f"_slot{t}", f"_bucket{t}", f"_bits{t}"} & taken)
    slot, bucket, bitmap = f"_slot{tail}", f"_bucket{tail}", f"_bits{tail}"

    def numbered(h):
        return F.pmod(h, F.lit(1 << bits)) + 1  # buckets count from 1, each of 32768 bits

    maps = keys.select(numbered(key_hash).alias(slot)) \
        .groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(bitmap))
    rows = df.withColumn(slot, numbered(hashed))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0
    return rows.join(F.broadcast(maps), F.bitmap_bucket_number(slot) == F.col(bucket), "left") \
        .withColumn(out, F.coalesce(bit, F.lit(False))).drop(slot, bucket, bitmap)


def probable_members(df: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column, bits: int = 26) -> DataFrame:
    """Rows of ``df`` whose 64-bit hash may be among those of ``keys``; see :func:`with_membership`."""
    return with_membership(df, hashed, keys, key_hash, "_member", bits).filter("_member").drop("_member")


def bitmap_of(keys: DataFrame, column: str, bits: int = 26) -> np.ndarray:
    """One bit for each 64-bit hash of ``keys`` modulo ``2**bits``, gathered with the bitmap aggregates: at most ``2**bits / 8`` bytes (8 MB) at any size."""
    slot = F.pmod(F.col(column), F.lit(1 << bits)) + 1  # buckets count from 1, each of 32768 bits
    rows = keys.select(F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")) \
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    table = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = (r["b"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(r["m"], np.uint8)
    return table


def in_bitmap(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of 64-bit hashes are set; ``table`` has a power of two of bytes."""
    at = hashes.astype(np.int64) & (len(table) * 8 - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def member_test(keys: DataFrame, column: str, bits: int = 26):
    """A function that tells whether a 64-bit hash may be among ``keys``, by their bitmap.

    It says yes too often when there are very many keys, never no for a key, so
    it is for keeping rows out of a shuffle, ahead of an exact join.
    """
    shared = keys.sparkSession.sparkContext.broadcast(bitmap_of(keys, column, bits))

    @F.pandas_udf("boolean")
    def among(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, h.to_numpy(np.int64)))

    return among
