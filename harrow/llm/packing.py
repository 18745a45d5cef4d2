"""Best-fit packing of token sequences, with large-item matching.

Documents become token pieces of at most ``capacity`` tokens.  How many pieces
there are of each length is all that the packing needs to know, and that
histogram has at most ``capacity`` rows at any corpus size:

1. lengths above a third of the capacity can share a sequence with at most one
   other such length; greedy matching pairs the longest left with the longest
   partner that fits;
2. shorter lengths, longest first, go to the smallest gap that takes them, and
   new sequences open when none does.

The plan says, for each length, which ranks go to which sequences at which
offset.  Pieces get their rank within their length from counts per (length,
bucket) and a row number inside the bucket, so a length that a third of all
pieces share is ranked by many tasks; no piece passes through the driver.

Defined cases: a null or empty text is one piece of the end token alone; rows
with null or repeated ids are packed like any others, each on its own.
"""
from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, staged, text_of, trim

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
CACHE = 250_000
# How the tokenizer cuts a text, for Latin letters (its rule for others is left to it).
LATIN = "a-zªµºß-öø-ſ"
TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9²³¹¼½¾]|[^\\s{LATIN}0-9²³¹¼½¾]+")
#: Other scripts, marks, the dotted I, control characters and special tokens.
OTHER = re.compile("[^\t-\r -~\x85\xa0-\u012f\u0131-\u017f]|<\\|")


@lru_cache(maxsize=2)
def _encoder(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks in parallel
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name) if "/" not in name else name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(extra)) for b in range(256)]


BYTE = _byte_letters()


class Words(dict):
    """Token ids, as little-endian 32-bit bytes, of the words met so far.

    The tokenizer cuts a text into words by a fixed pattern and encodes each on
    its own, so a text's ids are those of its words in turn.  Words go straight
    to the tokenizer's model.
    """

    def __init__(self, name: str):
        super().__init__()
        self.encoder = _encoder(name)
        self.model = self.encoder.model

    def __missing__(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join([BYTE[b] for b in word.encode()])
        ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if OTHER.search(text):
            return self.plain(text)
        return b"".join(map(self.__getitem__, TOKEN.findall(text.lower())))


def _pieces(name: str, capacity: int):
    tail = np.array([END_ID], "<u4").tobytes()

    @F.pandas_udf("array<struct<length:long,crc:long>>")
    def pieces(texts: pd.Series) -> pd.Series:
        words, out = _words(name), []
        for text in texts:
            ids = words.encode(text) + tail
            cut = [ids[k:k + 4 * capacity] for k in range(0, len(ids), 4 * capacity)]
            out.append([(len(c) // 4, zlib.crc32(c)) for c in cut])
        trim()
        return pd.Series(out, dtype=object)

    return pieces


@lru_cache(maxsize=2)
def _words(name: str) -> Words:
    return Words(name)


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece."""
    return docs.select("doc_id", F.posexplode(_pieces(tokenizer, capacity)(text_of())).alias("piece", "p")) \
        .select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("start"),
                F.col("p.length").alias("length"), F.col("p.crc").alias("ids_crc32"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Pack a histogram of lengths.

    Returns ``length, first rank (from 1), first sequence, offset`` of each run
    of pieces that go one each to consecutive sequences, and the number of
    sequences.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    rank = dict.fromkeys(left, 1)
    out: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    total = 0

    def put(length: int, seq: int, n: int, offset: int) -> None:
        out.append((length, rank[length], seq, offset))
        rank[length] += n
        left[length] -= n

    def leave(gap: int, seq: int, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            insort(order, gap)
        gaps[gap].append((seq, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        i = bisect_left(large, capacity - a + 1) - 1
        while i >= 0 and (not left[large[i]] or large[i] == a and left[a] < 2):
            if not left[large[i]]:
                large.pop(i)
            i -= 1
        b = large[i] if i >= 0 else 0
        n = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        put(a, total, n, 0)
        if b:
            put(b, total, n, a)
        if a + b < capacity:
            leave(capacity - a - b, total, n)
        total += n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            i = bisect_left(order, a)
            if i == len(order):
                # No gap takes it: fresh sequences, each filled as far as it goes.
                n = -(-left[a] // (capacity // a))
                leave(capacity, total, n)
                total += n
                continue
            gap = order[i]
            seq, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[i]
            k = min(n, left[a])
            put(a, seq, k, capacity - gap)
            if k < n:
                leave(gap, seq + k, n - k)
            if gap > a:
                leave(gap - a, seq, k)
    out.sort()
    cols = np.array(out, np.int64).reshape(-1, 4)
    return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3], total


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 100_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity``."""
    spark = pieces.sparkSession
    _row, _bucket, _n, _before, _in, _place = fresh(pieces, "_row", "_bucket", "_n", "_before", "_in", "_place")
    rows = staged(pieces.withColumn(_row, F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    length, first, seq, offset, _ = plan(counts, capacity)
    shared = spark.sparkContext.broadcast(((length << 42) + first, seq - first, offset))

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, shift, at = shared.value
        i = np.searchsorted(keys, (length.to_numpy(np.int64) << 42) + rank.to_numpy(np.int64), "right") - 1
        return pd.DataFrame({"sequence_id": shift[i] + rank.to_numpy(np.int64), "offset": at[i]})

    n = 16 + max(counts.values(), default=0) // bucket_rows
    bucketed = rows.withColumn(_bucket, F.pmod(F.xxhash64(_row), F.lit(n)))
    sizes = bucketed.groupBy("length", _bucket).agg(F.count(F.lit(1)).alias(_n))
    before = Window.partitionBy("length").orderBy(_bucket).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", _bucket, F.coalesce(F.sum(_n).over(before), F.lit(0)).alias(_before))
    inside = Window.partitionBy("length", _bucket).orderBy(_row)
    ranked = bucketed.withColumn(_in, F.row_number().over(inside)).join(sizes, ["length", _bucket]) \
        .withColumn(_place, place("length", F.col(_before) + F.col(_in)))
    return ranked.select(*pieces.columns, f"{_place}.sequence_id", f"{_place}.offset")


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of ``docs`` and their places."""
    return pack(token_pieces(docs, tokenizer, capacity), capacity)
