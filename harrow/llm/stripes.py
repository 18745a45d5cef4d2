"""Phrase collocations from stripes: every prefix keys a counter of its next words.

A stripe is ``(lang, prefix, slice, nexts, counts)``: how often each next word
follows the prefix within a piece.  Tasks build the stripes of some megabytes of
text at a time (in-mapper combining), Spark brings stripes of a key together in
order, and they are merged elementwise as a stream.  There are stripes of three
prefix lengths, and one structure gives all that the scores need:

* of the empty prefix: the words with their counts, and their sum ``n``;
* of one word: the phrases of two words;
* of two words: those of three.  The greatest count in the stripe of ``x y``, and
  among the ``y`` in stripes of ``w x``, tells whether a longer candidate subsumes ``x y``.

A phrase is no more frequent than its parts, so a length counts only phrases
whose parts were counted ``least`` times before.  A bitmap of 16 MB at most tells
the tasks which parts may have been; it lets some others through, so it only
saves work, and the counts decide.

No key gathers too much: the empty prefix has ``SLICES`` slices, and a word with
more than one part in ``SLICES`` of all words has a slice for each such part, by the hash of
the next word.  These words, at most ``SLICES``, are the only words that go to all tasks.

Defined cases: null texts are empty and give nothing; a null lang is ``und``;
rows with null or repeated ids count like any others; words are told apart by
their bytes; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, mix64, staged, text_of, trim

CUTS = ".,;:!?\n\x0b\x0c\r"
BREAK = b"."
TABLE = bytes.maketrans(bytes(range(65, 91)) + CUTS.encode() + b"\t", bytes(range(97, 123)) + BREAK * len(CUTS) + b" ")
FLUSH = 8 << 20
SLICES = 4096
BITS = 27
_MASK = np.uint64((1 << BITS) - 1)
_P = np.uint64(0x9E3779B97F4A7C15)
STRIPE = "lang string, prefix string, slice int, nexts array<string>, counts array<long>"
MERGED = f"{STRIPE}, total long, slots array<long>"


def word_hash(lang: bytes, words) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * _P + second)


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & _MASK).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def stripes_of(lang: bytes, texts: list[bytes], words: int, marks: tuple, hot: dict, most: int) -> pa.RecordBatch | None:
    """Stripes of prefixes of ``words`` words in some texts of one language."""
    tokens = BREAK.join(texts).translate(TABLE).replace(BREAK, b" . ").split()
    code, seen = pd.factorize(np.array([BREAK, *tokens], dtype=object))
    n = len(seen)
    h = word_hash(lang, seen)
    slices = np.array([hot.get((lang, w), 1) for w in seen], np.int64) if hot else np.ones(n, np.int64)
    if words == 0:
        count = np.bincount(code, minlength=n)[1:]
        first, following = np.zeros(n - 1, np.int64), np.arange(1, n)
        of = np.array([most])
    else:
        usable = _has(marks[0], h)
        usable[0] = False
        a, b = code[:-1], code[1:]
        linked = usable[a] & usable[b]
        if words == 1:
            key, count = np.unique(a[linked].astype(np.int64) * n + b[linked], return_counts=True)
            first, following, of = key // n, key % n, slices
        else:
            linked[linked] = _has(marks[1], pair_hash(h[a[linked]], h[b[linked]]))
            at = np.flatnonzero(linked[:-1] & linked[1:])
            pair, at_pair = np.unique(a[at].astype(np.int64) * n + b[at], return_inverse=True)
            key, count = np.unique(at_pair.astype(np.int64) * n + b[at + 1], return_counts=True)
            first, following = key // n, key % n
            of = np.minimum(slices[pair // n], slices[pair % n])
    if not len(count):
        return None
    part = (h[following] % of[first].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((part, first))
    first, following, part, count = first[order], following[order], part[order], count[order]
    start = np.flatnonzero(np.r_[True, (first[1:] != first[:-1]) | (part[1:] != part[:-1])])
    text = pc.cast(pa.array(seen, pa.binary()), pa.string(), safe=False)
    if words == 0:
        prefix = pa.array([""] * len(start), pa.string())
    elif words == 1:
        prefix = text.take(pa.array(first[start]))
    else:
        whole = pair[first[start]]
        prefix = pc.binary_join_element_wise(text.take(pa.array(whole // n)), text.take(pa.array(whole % n)), " ")
    offsets = np.r_[start, len(count)]
    return pa.record_batch([pa.array([lang.decode()] * len(start), pa.string()), prefix, pa.array(part[start], pa.int32()),
                            _lists(offsets, text.take(pa.array(following))), _lists(offsets, pa.array(count, pa.int64()))],
                           ["lang", "prefix", "slice", "nexts", "counts"])


def _build(words: int, marks, hot, most: int, flush_at: int):
    def run(batches):
        held: dict[bytes, list[bytes]] = {}
        size = 0
        bits, names = tuple(m.value for m in marks), hot.value if hot else {}

        def flush():
            for lang, texts in held.items():
                out = stripes_of(lang, texts, words, bits, names, most)
                if out is not None:
                    yield from (out.slice(i, 5000) for i in range(0, out.num_rows, 5000))
            held.clear()
            trim()

        for batch in batches:
            for lang, text in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.setdefault(lang, []).append(text)
                size += len(text) + 1
                if size >= flush_at:
                    yield from flush()
                    size = 0
        yield from flush()
    return run


def _sum(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Elementwise sums of the stripes of ``table``, one row a key in the same order, and their totals."""
    table = table.combine_chunks()
    cols = [table.column(c).chunk(0) if table.num_rows else table.column(c).combine_chunks() for c in table.column_names]
    new = np.zeros(table.num_rows - 1, bool)
    for c in cols[:3]:
        new |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    group = np.cumsum(np.r_[0, new])
    sizes = pc.list_value_length(cols[3]).to_numpy()
    flat = pa.table({"g": np.repeat(group, sizes), "next": cols[3].flatten(), "n": cols[4].flatten()})
    flat = flat.group_by(["g", "next"]).aggregate([("n", "sum")])
    flat = flat.take(pa.array(np.argsort(flat.column("g").to_numpy(), kind="stable")))
    g = flat.column("g").to_numpy()
    first = pa.array(np.flatnonzero(np.r_[True, new]))
    offsets = np.searchsorted(g, np.arange(group[-1] + 2))
    n = flat.column("n_sum").combine_chunks()
    out = pa.table([c.take(first) for c in cols[:3]] + [_lists(offsets, flat.column("next").combine_chunks()), _lists(offsets, n)],
                   ["lang", "prefix", "slice", "nexts", "counts"])
    return out, np.add.reduceat(n.to_numpy(), offsets[:-1])


def _kept(table: pa.Table, totals: np.ndarray, least: int) -> pa.RecordBatch:
    """Merged stripes with the elements that were counted ``least`` times, and the bitmap slots of these phrases."""
    counts, nexts = (table.column(c).combine_chunks().flatten() for c in ("counts", "nexts"))
    offsets = np.r_[0, np.cumsum(pc.list_value_length(table.column("counts").combine_chunks()).to_numpy())]
    often = counts.to_numpy() >= least
    offsets = np.r_[0, np.cumsum(often)][offsets]
    nexts, counts = nexts.filter(pa.array(often)), counts.filter(pa.array(often))
    langs, prefixes = (table.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "prefix"))
    slots = []
    follow = nexts.cast(pa.binary()).to_pylist()
    for k, (lang, prefix) in enumerate(zip(langs, prefixes)):
        i, j = offsets[k], offsets[k + 1]
        if i < j:
            h = word_hash(lang, follow[i:j])
            slots.append(pair_hash(word_hash(lang, [prefix]), h) if prefix else h)
    slots = (np.concatenate(slots) & _MASK).astype(np.int64) if slots else np.empty(0, np.int64)
    fields = [table.column(c).combine_chunks() for c in ("lang", "prefix", "slice")]
    return pa.record_batch([*fields, _lists(offsets, nexts), _lists(offsets, counts), pa.array(totals, pa.int64()),
                            _lists(offsets, pa.array(slots))], ["lang", "prefix", "slice", "nexts", "counts", "total", "slots"])


def _merge(least: int):
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table.cast(held.schema)])
            table, totals = _sum(table)
            # The last key may go on in the next batch.
            held = table.slice(table.num_rows - 1)
            if table.num_rows > 1:
                yield _kept(table.slice(0, table.num_rows - 1), totals[:-1], least)
        if held is not None:
            yield _kept(held, np.array([pc.sum(held.column("counts").combine_chunks().flatten()).as_py()]), least)
        trim()
    return run


def _marks(merged: DataFrame):
    """Bitmap of the phrases in ``merged``, for all tasks."""
    return merged.sparkSession.sparkContext.broadcast(bitmap(merged.select(F.explode("slots").alias("slot")), BITS))


def merged_stripes(docs: DataFrame, least: int = 10, slices: int = SLICES, flush: int = FLUSH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merged stripes of prefixes of 0, 1 and 2 words; elements counted less than ``least`` times are only in ``total``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    out, marks, hot = [], [], None
    for words in range(3):
        built = rows.mapInArrow(_build(words, tuple(marks), hot, slices, flush), STRIPE)
        by = ["lang", "prefix", "slice"]
        out.append(staged(built.repartition(*by).sortWithinPartitions(*by).mapInArrow(_merge(least), MERGED), f"stripes{words}"))
        if words < 2:
            marks.append(_marks(out[-1]))
        if words == 0:
            n = out[0].agg(F.sum("total")).first()[0] or 0
            often = elements(out[0]).filter(F.col("f") * slices > n).collect()
            hot = spark.sparkContext.broadcast({(r["lang"].encode(), r["next"].encode()): -(-slices * r["f"] // n) for r in often})
    return tuple(out)


def elements(stripes: DataFrame) -> DataFrame:
    """``lang, prefix, next, f`` of the elements of merged stripes."""
    return stripes.select("lang", "prefix", F.explode(F.arrays_zip("nexts", "counts")).alias("e")) \
        .select("lang", "prefix", F.col("e.nexts").alias("next"), F.col("e.counts").alias("f"))


def _score(a: str, l: str, r: str):
    """``floor(1000000 * a * a / (l * r))`` in whole decimals."""
    return F.expr(f"(CAST({a} AS DECIMAL(15,0)) * CAST({a} AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) "
                  f"div (CAST({l} AS DECIMAL(15,0)) * CAST({r} AS DECIMAL(15,0)))")


def scored(docs: DataFrame, least: int = 10, share: int = 50, **sizes) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, a, l, r, score`` of the candidates that no longer one subsumes (``share`` percent of ``a``), and ``lang, n``."""
    zero, one, two = merged_stripes(docs, least, **sizes)
    total = zero.groupBy("lang").agg(F.sum("total").alias("n"))
    word = elements(zero).select("lang", F.col("next").alias("w"), F.col("f").alias("fw"))
    pair = elements(one).select("lang", F.col("prefix").alias("x"), F.col("next").alias("y"), F.col("f").alias("a"))
    triple = elements(two).select("lang", F.split("prefix", " ").alias("p"), F.col("next").alias("z"), F.col("f").alias("a")) \
        .select("lang", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "z", "a")

    def count_of(df, column, out):
        return df.join(word.select("lang", F.col("w").alias(column), F.col("fw").alias(out)), ["lang", column])

    longest = triple.select("lang", "x", "y", "a").unionByName(triple.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a")) \
        .groupBy("lang", "x", "y").agg(F.max("a").alias("longer"))
    short = count_of(count_of(pair, "x", "l"), "y", "r").join(longest, ["lang", "x", "y"], "left") \
        .filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))) \
        .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    long = triple.join(pair.select("lang", "x", "y", F.col("a").alias("xy")), ["lang", "x", "y"]) \
        .join(pair.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("yz")), ["lang", "y", "z"])
    long = count_of(count_of(long, "x", "fx"), "z", "fz").withColumn("s1", _score("a", "fx", "yz")).withColumn("s2", _score("a", "xy", "fz"))
    early = F.col("s1") <= F.col("s2")
    long = long.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.when(early, F.col("fx")).otherwise(F.col("xy")).alias("l"),
                       F.when(early, F.col("yz")).otherwise(F.col("fz")).alias("r"), F.least("s1", "s2").alias("score"))
    return short.unionByName(long), total


def collocations(docs: DataFrame, top: int = 2000, least: int = 10, share: int = 50, **sizes) -> DataFrame:
    """The first ``top`` phrases of each lang: ``lang, rank, phrase, a, l, r, n, score`` (``sizes`` go to ``merged_stripes``)."""
    rows, total = scored(docs, least, share, **sizes)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).join(total, "lang") \
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
