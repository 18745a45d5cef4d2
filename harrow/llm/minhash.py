"""Near-duplicate documents by weighted MinHash with darts, and banded joining.

A document is the multiset of its word shingles (five words each).  DartMinHash:
the plane of (weight, rank) is cut into unit cells, each with Poisson(1) darts
that only depend on the element and the cell, so all documents see the same
darts.  The darts that hit a document lie left of an element's weight and below
the rank ``t / total weight``; about ``t`` of them do, whatever the size.  Every
dart falls in one of ``k`` coordinates, and each coordinate keeps its earliest
dart.  Two documents agree in a coordinate with the probability of their
weighted Jaccard similarity (sum of minima over sum of maxima).

Signatures are cut into bands; documents that agree in a whole band meet in a
bucket.  First every document is compared with the hub of its buckets, the one
that shares most, which joins most copies to their source.  Buckets whose
members are then of several classes are compared on the shingles: split into
blocks of bounded size, each pair of blocks is a unit of work, in which the
members of different classes are compared by products of 0/1 matrices and only a
spanning forest of the links found is written.  So every pair that shares a band
is in one class or has been compared, and no list of pairs is made.

Exact copies are collapsed first, so large groups of them cost one document.

Defined cases: words are runs of letters, digits and underscores in lower case;
a text of fewer than five words is one shingle of them all; a text without words
has only its exact copies in its class (null is the empty text); rows with equal
ids are one document; a row with a null id is a class of its own and is kept.
"""
from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, fresh, member_test, mix64, staged, text_of, trim

WORD = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Chance of at most 0, 1, 2, ... darts in a cell.
_POISSON = np.exp(-1) * np.cumsum([1 / np.prod(np.arange(1, i + 1), dtype=float) for i in range(19)])


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles, ascending, and how often each occurs."""
    words = WORD.findall(text.lower())
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(size, len(h))):
        out *= _A
        out += h[j:j + n]
    return np.unique(mix64(out), return_counts=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_minhash(elements: np.ndarray, weights: np.ndarray, k: int = BANDS * ROWS) -> np.ndarray:
    """The ids of the earliest darts, one for each of ``k`` coordinates."""
    total = float(weights.sum())
    cells = np.ceil(weights).astype(np.int64)
    # Unit cells of the weights: element and index.
    e = np.repeat(elements, cells)
    x = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    base = mix64(e + x.astype(np.uint64) * _A)
    room = np.repeat(weights, cells) - x
    whole = bool((room >= 1).all())
    best = np.full(k, np.inf)
    ids = np.zeros(k, np.uint64)
    t, below = k * (np.log(k) + 2.0), 0
    while True:
        theta = t / total
        # All rank cells not looked at so far; the highest is open as far as theta.
        ranks = np.arange(below, int(np.ceil(theta)))
        cell = mix64((base[None, :] ^ ((ranks.astype(np.uint64) + np.uint64(1)) * _B)[:, None]).ravel())
        n = np.searchsorted(_POISSON, _unit(cell))
        d = np.repeat(cell, n)
        i = np.arange(len(d)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix64(d + (i.astype(np.uint64) + np.uint64(1)) * _A)
        rank = np.repeat(np.repeat(ranks, len(base)), n) + _unit(mix64(dart ^ _B))
        hit = rank < theta
        if not whole:
            hit &= _unit(mix64(dart ^ _A)) < np.repeat(np.tile(room, len(ranks)), n)
        dart, rank = dart[hit], rank[hit]
        late_first = np.argsort(rank)[::-1]
        dart, rank = dart[late_first], rank[late_first]
        slot = (dart % np.uint64(k)).astype(np.int64)
        own, own_id = np.full(k, np.inf), np.zeros(k, np.uint64)
        own[slot], own_id[slot] = rank, dart  # of equal slots the last, which is the earliest dart, stays
        better = own < best
        best[better], ids[better] = own[better], own_id[better]
        if np.isfinite(best).all():
            return ids
        # A coordinate without a dart: look further.  The last rank cell was cut, so it is read again.
        below, t = int(np.floor(theta)), t * 2


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either else 1.0


def _buckets(bands: int, rows: int):
    def run(batches):
        for b in batches:
            out = []
            for text in b["text"]:
                e, w = shingles(text)
                if not len(e):
                    out.append([])
                    continue
                s = dart_minhash(e, w, bands * rows).reshape(bands, rows)
                h = np.zeros(bands, np.uint64)
                for c in range(rows):
                    h = mix64(h * _A + s[:, c])
                out.append(mix64(h + np.arange(bands, dtype=np.uint64) * _B).view(np.int64))
            yield pd.DataFrame({"id": b["id"], "copy": b["copy"], "buckets": out})
        trim()
    return run


@F.pandas_udf(T.DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    cached = lru_cache(maxsize=256)(shingles)
    return pd.Series([similarity(cached(x), cached(y)) for x, y in zip(a, b)], dtype="float64")


def _ends(docs: DataFrame, *ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id occurs in a column of ``ids``, and perhaps a few more."""
    keys = ids[0].select(F.xxhash64(ids[0].columns[0]).alias("k"))
    for d in ids[1:]:
        keys = keys.unionByName(d.select(F.xxhash64(d.columns[0]).alias("k")))
    return docs.filter(member_test(keys, "k")(F.xxhash64("id")))


def overlaps(docs: list[tuple[np.ndarray, np.ndarray]], columns: int = 8192) -> np.ndarray:
    """Sums of minima of all pairs of multisets: products of 0/1 matrices, a slice of the elements at a time.

    An element that occurs three times counts as three: its first, second and third.
    """
    sizes = [int(w.sum()) for _, w in docs]
    owner = np.repeat(np.arange(len(docs)), sizes)
    element = np.concatenate([np.repeat(e, w) for e, w in docs])
    nth = np.concatenate([np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) for _, w in docs])
    _, col, n = np.unique(mix64(element + nth.astype(np.uint64) * _B), return_inverse=True, return_counts=True)
    # Elements of one document alone add nothing.
    shared = np.flatnonzero(n > 1)
    new = np.full(len(n), -1)
    new[shared] = np.arange(len(shared))
    col = new[col]
    owner, col = owner[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both = np.zeros((len(docs), len(docs)), np.float32)
    for c in range(0, len(shared), columns):
        a, z = np.searchsorted(col, [c, c + columns])
        x = np.zeros((len(docs), min(columns, len(shared) - c)), np.float32)
        x[owner[a:z], col[a:z] - c] = 1.0
        both += x @ x.T
    return both


def links(ids: np.ndarray, classes: np.ndarray, texts: list[str], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different classes."""
    docs = [shingles(t) for t in texts]
    total = np.array([w.sum() for _, w in docs], float)
    both = overlaps(docs)
    either = total[:, None] + total[None, :] - both
    a, b = np.nonzero(np.triu(both >= threshold * either - 1e-6, 1) & (classes[:, None] != classes[None, :]))
    root = {c: c for c in classes.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(classes[i]), find(classes[j])
        if x != y and similarity(docs[i], docs[j]) >= threshold:
            root[y] = x
            out.append((int(ids[i]), int(ids[j])))
    return out


def _compare(threshold: float):
    """Links inside each unit; the units of a partition come one after another."""
    unit = ["bucket", "low", "high"]

    def run(batches):
        held, last = [], None

        def flush():
            pdf = pd.concat(held)
            got = links(pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["text"].tolist(), threshold)
            return pd.DataFrame(got, columns=["a", "b"]) if got else None

        for b in batches:
            if not len(b):
                continue
            change = np.flatnonzero((b[unit].to_numpy()[1:] != b[unit].to_numpy()[:-1]).any(axis=1)) + 1
            for a, z in zip(np.r_[0, change], np.r_[change, len(b)]):
                key = tuple(b[unit].iloc[a])
                if held and key != last:
                    if (out := flush()) is not None:
                        yield out
                    held = []
                held.append(b.iloc[a:z])
                last = key
        if held and (out := flush()) is not None:
            yield out
        trim()
    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                    block: int = 256) -> DataFrame:
    """``doc_id, component_id, kept`` for every row; ``component_id`` is the smallest id of its class."""
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"))
    signed = staged(known.withColumn("copy", F.unhex(F.md5("text"))).mapInPandas(
        _buckets(bands, rows), "id long, copy binary, buckets array<long>"), "signatures")
    # Written, so that the joins on it can be split where one text has very many copies.
    heads = staged(signed.groupBy("copy").agg(F.min("id").alias("id")), "heads")
    members = staged(signed.join(heads, ["id", "copy"], "left_semi").select("id", F.explode("buckets").alias("bucket")), "members")
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = staged(members.join(shared, "bucket"), "members")
    # How much a document shares with others; the text that others were made from has most.
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    members = staged(members.join(degree, "id").withColumn("hub", F.struct("degree", (-F.col("id")).alias("minus"))), "members")
    hubs = members.groupBy("bucket").agg(F.max("hub").alias("top"))
    near = staged(members.join(hubs, "bucket").filter("top.minus <> -id").groupBy("id")
                  .agg((-F.max("top").getField("minus")).alias("a")).withColumnRenamed("id", "b"), "near")
    texts = _ends(known, near.select("a"), near.select("b"))
    edges = staged(near.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
                   .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
                   .filter(_similarity("ta", "tb") >= threshold).select("a", "b"), "links")

    active = members.select("bucket", "id").join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = active.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")) \
        .filter("lo < hi").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    active = active.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    active = staged(active.select("bucket", "id", "component", F.least("part", "other").alias("low"),
                                  F.greatest("part", "other").alias("high")), "active")
    unit = ["bucket", "low", "high"]
    units = active.join(_ends(known, active.select("id")), "id").repartition(*unit).sortWithinPartitions(*unit)
    edges = staged(edges.unionByName(units.mapInPandas(_compare(threshold), "a long, b long")), "links")

    # Links between texts, and from the first of the exact copies to the others.
    copies = signed.select(F.col("id").alias("b"), "copy").join(heads.withColumnRenamed("id", "a"), "copy").select("a", "b")
    label = components(edges.unionByName(copies)).withColumnRenamed("id", "doc_id")
    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("doc_id")).join(label, "doc_id", "left") \
        .select("doc_id", F.coalesce("component", "doc_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each class: that with the smallest id, all columns kept."""
    found = staged(near_duplicates(docs, **options), "classes")
    n = found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"))
    _id, _hit, _kept = fresh(docs, "_id", "_hit", "_kept")
    spare = staged(n.filter("n > 1 or not kept").select(F.col("doc_id").alias(_id), F.col("kept").alias(_kept)), "spare")
    among = member_test(spare.select(F.xxhash64(_id).alias("k")), "k")
    marked = docs.withColumn(_id, F.col("doc_id").cast("long")) \
        .withColumn(_hit, F.col("doc_id").isNotNull() & among(F.xxhash64(_id)))
    # Only rows that may go are shuffled.
    checked = marked.filter(F.col(_hit)).join(spare, _id, "left").filter(F.coalesce(F.col(_kept), F.lit(True))) \
        .dropDuplicates([_id]).select(*docs.columns)
    return marked.filter(~F.col(_hit)).select(*docs.columns).unionByName(checked)
