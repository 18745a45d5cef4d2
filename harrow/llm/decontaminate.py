"""Benchmark passages inside documents, by the q-gram lemma over diagonal bands.

An item of ``m`` characters that occurs in a text with at most ``k`` edits
shares at least ``m - q + 1 - k*q`` of its q-grams with it, and all of them lie
on diagonals (text position minus item position) at most ``2k`` apart.  Text
q-grams are looked up in the item q-grams by rolling hashes; hits are counted in
overlapping diagonal bands that hold every such window whole; the bands that
reach the bound are verified by banded alignment.  Nothing inside the edit
budget is lost: q-grams shared by very many items are not looked up, and the
bound of each item is lowered by as many.

Texts and items are compared in lower case with white space runs as one space.

Items are taken in blocks of at most ``block_chars`` characters, so what goes to
every task has a fixed bound; one block usually holds a whole benchmark.

Defined cases: null or empty texts and items match nothing, nor do items with a
null id; an item shorter than ``q`` matches where it is contained; repeated
items each match; repeated rows are treated alike; other columns are not looked
at.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, runs, text_of, trim

BASE = np.uint64(0x100000001B3)
BITS = 22


def normal(text: str) -> str:
    return " ".join(text.replace("\0", " ").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Rolling hash of every q-gram."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    n = len(c) - q + 1
    h = c[:n].astype(np.uint64)
    for j in range(1, q):
        h *= BASE
        h += c[j:j + n]
    return h


@dataclass
class Index:
    """Item q-grams of one block: sorted hashes, and the places of each."""

    q: int
    ids: list[int]
    texts: list[str]
    budget: np.ndarray
    need: np.ndarray
    keys: np.ndarray
    start: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    table: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, str]], q: int, rate: float, common: int) -> Index:
        rows = [(i, t) for i, t in rows if t]
        ids, texts = [i for i, _ in rows], [t for _, t in rows]
        m = np.array([len(t) for t in texts], np.int64)
        k = np.maximum(0, np.minimum((rate * m).astype(np.int64), (m - q) // q))
        per = [grams(codes(t), q) for t in texts]
        h = np.concatenate(per) if per else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(per)), [len(p) for p in per]).astype(np.int64)
        pos = np.concatenate([np.arange(len(p)) for p in per]) if per else np.empty(0, np.int64)
        need = m - q + 1 - k * q
        order = np.argsort(h, kind="stable")
        h, item, pos = h[order], item[order], pos[order]
        keys, start, n = np.unique(h, return_index=True, return_counts=True)
        # Frequent q-grams are skipped as far as every item keeps a bound of at least one.
        skip = np.repeat(n > common, n)
        lost = np.bincount(item[skip], minlength=len(texts)) if len(texts) else np.empty(0, np.int64)
        safe = need - lost >= 1
        skip &= safe[item] if len(item) else False
        need = need - np.bincount(item[skip], minlength=len(texts))
        h, item, pos = h[~skip], item[~skip], pos[~skip]
        keys, start = np.unique(h, return_index=True)
        table = np.zeros(1 << BITS, bool)
        table[cls.slot(keys)] = True
        return cls(q, ids, texts, k, need, keys, np.append(start, len(h)), item, pos, table)

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(text position, item, item position)`` of all shared q-grams."""
        at = np.flatnonzero(self.table[self.slot(h)])
        where = np.searchsorted(self.keys, h[at])
        where[where == len(self.keys)] = 0
        ok = self.keys[where] == h[at]
        at, where = at[ok], where[ok]
        n = self.start[where + 1] - self.start[where]
        first = np.repeat(self.start[where] - np.cumsum(n) + n, n)
        place = first + np.arange(n.sum())
        return np.repeat(at, n), self.item[place], self.pos[place]


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int) -> int:
    """Least edits of ``item`` against any part of ``text`` on diagonals ``low..high-1``."""
    width, m, n = high - low, len(item), len(text)
    big = m + n + 1
    offset = np.arange(width)
    col = low + offset  # text position before which row 0 ends, on each diagonal
    row = np.where((col >= 0) & (col <= n), 0, big)
    padded = np.full(n + 2, -1, np.int64)
    padded[1:n + 1] = text
    for i in range(m):
        col = low + offset + i  # text character used by a diagonal step
        same = padded[np.clip(col + 1, 0, n + 1)] == item[i]
        new = row + ~same
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[(col + 1 < 0) | (col + 1 > n)] = big
        row = np.minimum.accumulate(new - offset) + offset
        if row.min() > m:
            break
    return int(row.min())


def matches(texts: list[str], index: Index) -> list[list[tuple[int, int, int]]]:
    """Per text, ``(item id, edits, start)`` of its items; start counts in the normalised text."""
    out: list[list] = [[] for _ in texts]
    if not index.ids:
        return out
    for n, t in enumerate(texts):
        out[n] += [(index.ids[i], 0, t.find(x)) for i, x in enumerate(index.texts) if len(x) < index.q and x in t]
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    c = codes("\0".join(texts))
    at, item, pos = index.hits(grams(c, index.q))
    if not len(at):
        return out
    doc = np.searchsorted(starts, at, "right") - 1
    width = 2 * index.budget[item] + 1
    band = (at - starts[doc] - pos) // width
    n_items = len(index.ids)
    # A diagonal lies in two bands: [j, j + 2) widths for j = band - 1 and j = band.
    pair = np.concatenate([doc * n_items + item] * 2)
    j = np.concatenate([band - 1, band])
    p = np.concatenate([pos, pos])
    key = np.unique(np.stack([pair, j, p]), axis=1) if len(pair) < 64 else _distinct(pair, j, p)
    change = np.flatnonzero(np.r_[True, (np.diff(key[0]) != 0) | (np.diff(key[1]) != 0)])
    count = np.diff(np.r_[change, key.shape[1]])
    pair, j = key[0][change], key[1][change]
    full = count >= index.need[pair % n_items]
    best: dict[int, tuple[int, int]] = {}
    for pr, jj in zip(pair[full].tolist(), j[full].tolist()):
        d, i = divmod(pr, n_items)
        if best.get(pr, (1,))[0] == 0:
            continue
        text, x, k = texts[d], index.texts[i], int(index.budget[i])
        exact = text.find(x)
        if exact >= 0:
            best[pr] = (0, exact)
            continue
        w = 2 * k + 1
        low = jj * w
        lo, hi = max(0, low), min(len(text), low + 2 * w + len(x))
        e = banded(codes(x).astype(np.int64), codes(text[lo:hi]).astype(np.int64), low - lo, low + 2 * w - lo)
        if e <= k and e < best.get(pr, (k + 1,))[0]:
            best[pr] = (e, lo)
    for pr, (e, at_) in sorted(best.items()):
        d, i = divmod(pr, n_items)
        out[d].append((index.ids[i], e, at_))
    return out


def _distinct(*cols: np.ndarray) -> np.ndarray:
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    keep = np.r_[True, np.any([np.diff(c) != 0 for c in cols], axis=0)]
    return np.stack([c[keep] for c in cols])


def blocks(benchmark: DataFrame, block_chars: int):
    """The benchmark's normalised rows, at most about ``block_chars`` characters at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")) \
        .filter("text <> '' and item_id is not null")
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r["item_id"], normal(r["text"])) for r in part.orderBy("item_id", "text").collect()]


LEAKS = "array<struct<item_id:long,edits:int,start:int>>"


def _leaks(index):
    @F.pandas_udf(LEAKS)
    def leaks(column: pd.Series) -> pd.Series:
        texts = [normal(x) for x in column]
        got: list = []
        for part in runs([len(t) for t in texts], 500_000):
            got += matches(texts[part], index.value)
        trim()
        return pd.Series(got, dtype=object)

    return leaks


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, q: int = 8, common: int = 4,
                 block_chars: int = 4_000_000, out: str = "leaks") -> DataFrame:
    """``docs`` with ``out``: array of ``(item_id, edits, start)`` of the items found in its text."""
    found = docs.withColumn(out, F.array().cast(LEAKS))
    for rows in blocks(benchmark, block_chars):
        leaks = _leaks(docs.sparkSession.sparkContext.broadcast(Index.build(rows, q, rate, common)))
        found = found.withColumn(out, F.concat(out, leaks(text_of())))
    return found


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: ``doc_id, contaminated, item_ids`` (ascending), ``edits`` (least)."""
    kept = docs.select("doc_id", "text")
    found = contaminated(kept, benchmark, **options)
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"),
                        F.array_sort(F.array_distinct(F.col("leaks.item_id"))).alias("item_ids"),
                        F.array_min(F.col("leaks.edits")).alias("edits"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns kept."""
    (out,) = fresh(docs, "_leaks")
    return contaminated(docs, benchmark, out=out, **options).filter(F.size(out) == 0).drop(out)
