"""Near-duplicate embeddings by a robust-pruned flat graph.

1. *Shards*: spherical k-means centroids, fitted on a bounded hash sample
   (``sample`` vectors), send every vector to its ``overlap`` nearest cells, so
   shards overlap.  A cell with more than ``shard_rows`` vectors is split by hash
   and every pair of its parts is a unit of work, so a dense region is shared by
   many tasks and no pair of its vectors is lost.
2. *Graph*: in each unit every vector takes its nearest candidates and a few
   random ones; robust pruning drops a candidate that is closer, by the factor
   ``alpha``, to one already taken.  Edges count in both directions.  The
   adjacency lists of all units are united by vector.
3. *Search*: in each unit every vector is a query.  The greedy search starts from
   the unit's medoid and the query's own node, keeps a beam, and from the beam
   expands every node that lies within a widened range until no more are found.
4. *Verification*: pairs found count with a cosine of at least ``threshold`` in
   double precision.  A pair that shares several units counts in the first one.

Equal vectors are collapsed before and counted with their number.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths have no cosine, so each
length has cells of its own; rows with equal ids are one vector each for the counts
and share the smallest component of them.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

THRESHOLD = 0.9
SHARD_ROWS = 2000
SAMPLE = 20_000


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can link with others, as doubles in ``x``."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0.0)
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(F.coalesce(fine, F.lit(False))) \
        .select(F.col("vec_id").cast("long").alias("id"), x.alias("x"))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def _cells(centers: dict[int, tuple[int, np.ndarray | None]], overlap: int):
    """Adds the nearest cells; ``centers`` has the first cell and the centroids of each length, none where one cell is enough."""
    def run(batches):
        for b in batches:
            size = b["x"].map(len)
            for length, rows in b.groupby(size, sort=False):
                first, c = centers[length]
                x = unit_rows(np.array(rows["x"].tolist(), float))
                if c is None:
                    yield rows.assign(x=list(x), cells=[[first]] * len(rows))
                    continue
                m = min(overlap, len(c))
                near = np.sort(np.argpartition(-(x @ c.T), m - 1, axis=1)[:, :m], axis=1) + first
                yield rows.assign(x=list(x), cells=list(near.astype(np.int32)))
    return run


def pruned(x: np.ndarray, degree: int, candidates: int, alpha: float, rng: np.random.Generator) -> list[np.ndarray]:
    """Out-neighbours of every row of unit vectors after robust pruning."""
    n = len(x)
    out: list[np.ndarray] = []
    take = min(candidates, n - 1)
    if take <= 0:
        return [np.empty(0, np.int64)] * n
    for a in range(0, n, 512):
        s = x[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near = np.argpartition(-s, take - 1, axis=1)[:, :take]
        for i in range(len(s)):
            c = np.unique(np.r_[near[i], rng.integers(0, n, 8)])
            c = c[c != a + i]
            d = np.sqrt(np.maximum(0, 2 - 2 * s[i, c]))
            order = np.argsort(d, kind="stable")
            c, d = c[order], d[order]
            between = np.sqrt(np.maximum(0, 2 - 2 * (x[c] @ x[c].T)))
            alive, kept = np.ones(len(c), bool), []
            for j in range(len(c)):
                if alive[j]:
                    kept.append(j)
                    if len(kept) == degree:
                        break
                    alive &= alpha * between[j] > d
            out.append(c[kept])
    return out


def _units(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """A row for each vector and unit: cell, the two parts of the unit, the own part."""
    at = rows.select("id", "x", "copies", "cells", F.explode("cells").alias("cell")).join(parts, "cell")
    at = at.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    other = F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))
    return at.withColumn("other", F.explode(other)).select(
        "id", "x", "copies", "cells", "cell", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def _build(degree: int, candidates: int, alpha: float):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").drop_duplicates("id")
        ids = pdf["id"].to_numpy()
        x = np.array(pdf["x"].tolist(), float)
        rng = np.random.default_rng([int(pdf["cell"].iloc[0]), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])])
        near = pruned(x, degree, candidates, alpha, rng)
        return pd.DataFrame({"id": ids, "near": [ids[j] for j in near]})
    return build


def search(x: np.ndarray, start: np.ndarray, edges: np.ndarray, medoid: int, q: np.ndarray, threshold: float,
           beam: int = 16, widen: float = 0.08) -> tuple[np.ndarray, np.ndarray]:
    """Pairs ``(query, node)`` with a cosine of at least ``threshold`` that the graph search meets.

    ``start, edges`` are the adjacency lists; ``q`` are the nodes that are queries.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n), bool)
    found_q, found_n = [], []
    # Nodes to expand: the medoid and the query itself.
    fq, fn = np.r_[np.arange(m), np.arange(m)], np.r_[np.full(m, medoid), q]
    key = np.unique(fq * n + fn)
    fq, fn = key // n, key % n
    seen[fq, fn] = True
    best = np.full((m, beam), -2.0)
    fs = np.einsum("ij,ij->i", x[q[fq]], x[fn])
    hit = fs >= threshold
    found_q.append(fq[hit])
    found_n.append(fn[hit])
    while len(fq):
        size = start[fn + 1] - start[fn]
        nq = np.repeat(fq, size)
        nn = edges[np.repeat(start[fn], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        key = np.unique((nq * n + nn)[~seen[nq, nn]])
        nq, nn = key // n, key % n
        seen[nq, nn] = True
        s = np.concatenate([np.einsum("ij,ij->i", x[q[nq[i:i + 200_000]]], x[nn[i:i + 200_000]]) for i in range(0, len(nq), 200_000)]) \
            if len(nq) else np.empty(0)
        hit = s >= threshold
        found_q.append(nq[hit])
        found_n.append(nn[hit])
        # The beam: the best similarities of each query so far; a node goes on if it enters the beam or is in the range.
        order = np.lexsort((-s, nq))
        rank = np.arange(len(nq)) - np.searchsorted(nq[order], nq[order])
        top = order[rank < beam]
        fresh = np.full((m, beam), -2.0)
        fresh[nq[top], rank[rank < beam]] = s[top]
        both = np.sort(np.concatenate([best, fresh], axis=1), axis=1)[:, -beam:]
        better = (both > best).any(axis=1)
        best = both
        go = (s >= threshold - widen) | ((s >= best[nq, 0]) & better[nq])
        fq, fn = nq[go], nn[go]
    return np.concatenate(found_q), np.concatenate(found_n)


def _search(threshold: float):
    def run(key, vectors: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        pdf = vectors.sort_values("id").drop_duplicates("id").reset_index(drop=True)
        ids, x = pdf["id"].to_numpy(), np.array(pdf["x"].tolist(), float)
        n = len(ids)
        copies, part = pdf["copies"].to_numpy(), pdf["part"].to_numpy()
        cell, low, high = (int(k) for k in key)
        # United adjacency, restricted to the nodes that are here, both ways.
        src = np.searchsorted(ids, np.repeat(graph["id"].to_numpy(), [len(v) for v in graph["near"]]))
        to = np.concatenate([np.asarray(v, np.int64) for v in graph["near"]] or [np.empty(0, np.int64)])
        at = np.searchsorted(ids, to)
        here = (at < n) & (ids[np.minimum(at, n - 1)] == to)
        src, at = src[here], at[here]
        pair = np.unique(np.r_[src * n + at, at * n + src])
        start = np.searchsorted(pair // n, np.arange(n + 1))
        edges = pair % n
        mean = x.mean(axis=0)
        medoid = int(np.argmax(x @ mean))
        cells = [frozenset(c) for c in pdf["cells"]]
        a, b = [], []
        for i in range(0, n, 256):
            q = np.arange(i, min(n, i + 256))
            fq, fn = search(x, start, edges, medoid, q, threshold)
            a.append(q[fq])
            b.append(fn)
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
        a, b = pair // n, pair % n
        ok = a != b
        if low != high:
            ok &= part[a] != part[b]
        a, b = a[ok], b[ok]
        # Exact cosine, and the first shared cell only.
        cosine = np.concatenate([(x[a[i:i + 100_000]] * x[b[i:i + 100_000]]).sum(axis=1) for i in range(0, len(a), 100_000)]) if len(a) else np.empty(0)
        a, b = a[cosine >= threshold], b[cosine >= threshold]
        memo: dict = {}

        def first(i, j):
            k = (cells[i], cells[j])
            if k not in memo:
                memo[k] = min(cells[i] & cells[j]) == cell
            return memo[k]

        own = np.fromiter((first(i, j) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
        links = np.bincount(a[own], weights=copies[b[own]], minlength=n) + np.bincount(b[own], weights=copies[a[own]], minlength=n)
        # For the components a spanning forest is enough: each node and the smallest that it reaches here.
        root = np.arange(n)
        while True:
            least = root.copy()
            np.minimum.at(least, a, root[b])
            np.minimum.at(least, b, root[a])
            least = least[least]
            if (least == root).all():
                break
            root = least
        some = np.flatnonzero((links > 0) | (root != np.arange(n)))
        return pd.DataFrame({"id": ids[some], "links": links[some].astype(np.int64), "root": ids[root[some]]})
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = 3, shard_rows: int = SHARD_ROWS,
                 sample: int = SAMPLE, max_cells: int = 1024, degree: int = 24, candidates: int = 48,
                 alpha: float = 1.2) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    rows = usable(vectors).withColumn("copy", F.sha2(F.concat_ws(",", F.transform("x", lambda v: (v + 0.0).cast("string"))), 256))
    copies = staged(rows.select("id", "copy"), "copies")
    heads = copies.groupBy("copy").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    distinct = rows.join(heads, ["copy", "id"]).dropDuplicates(["id", "copy"]).select("id", "x", "copies")
    distinct = staged(distinct, "vectors")
    numbers = {r["size"]: r["n"] for r in distinct.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    # Lengths with many vectors get centroids, from a sample that they share; the others get one cell.
    many = {k: v for k, v in numbers.items() if v > shard_rows}
    share = min(1.0, sample / max(1, sum(many.values())))
    drawn = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    picked: dict[int, list] = {}
    for r in distinct.filter(F.size("x").isin(list(many)) & drawn).select("x").collect() if many else ():
        picked.setdefault(len(r["x"]), []).append(r["x"])
    centers, total = {}, 0
    for length in sorted(numbers):
        own = np.array(picked.get(length, ()), float).reshape(-1, length)
        cells = max(1, min(max_cells, -(-numbers[length] * overlap // shard_rows), max(1, len(own) // 8)))
        centers[length] = (total, centroids(unit_rows(own), cells) if len(own) else None)
        total += cells if len(own) else 1
    placed = staged(distinct.mapInPandas(_cells(centers, overlap), "id long, x array<double>, copies long, cells array<int>"), "cells")
    parts = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")) \
        .select("cell", F.ceil(F.col("n") / (2.0 * shard_rows)).alias("parts"))
    units = staged(_units(placed, parts), "units")
    unit = ["cell", "low", "high"]
    near = units.groupBy(*unit).applyInPandas(_build(degree, candidates, alpha), "id long, near array<long>")
    graph = staged(near.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    lists = staged(units.select("id", *unit).join(graph, "id"), "lists")
    found = staged(units.groupBy(*unit).cogroup(lists.groupBy(*unit)).applyInPandas(
        _search(threshold), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = copies.join(heads.select("copy", F.col("id").alias("head"), "copies"), "copy")
    label = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(
        joined.select(F.col("head").alias("a"), F.col("id").alias("b"))))
    counted = joined.join(links.withColumnRenamed("id", "head"), "head", "left") \
        .select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")).groupBy("id").agg(F.max("n").alias("n"))
    return alone.join(counted.withColumnRenamed("id", "vec_id"), "vec_id", "left") \
        .join(label.withColumnRenamed("id", "vec_id"), "vec_id", "left") \
        .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def recall(vectors: DataFrame, result: DataFrame, threshold: float = THRESHOLD, queries: int = 200) -> float:
    """Share of the links of a hash sample of queries, by brute force over all rows in blocks, that ``result`` counts."""
    rows = usable(vectors)
    asked = rows.orderBy(F.xxhash64("id", F.lit(11))).limit(queries).collect()
    by_length: dict[int, list] = {}
    for r in asked:
        by_length.setdefault(len(r["x"]), []).append(r)
    q = {k: (np.array([r["id"] for r in v]), unit_rows(np.array([r["x"] for r in v], float))) for k, v in by_length.items()}

    def block(batches):
        for b in batches:
            for length, own in b.groupby(b["x"].map(len), sort=False):
                if length in q:
                    ids, x = q[length]
                    s = unit_rows(np.array(own["x"].tolist(), float)) @ x.T >= threshold
                    yield pd.DataFrame({"id": ids, "n": s.sum(axis=0)})

    true = rows.mapInPandas(block, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(result.select(F.col("vec_id").alias("id"), "n_links"), "id") \
        .agg(F.sum(F.least("n", "n_links")).alias("got"), F.sum("n").alias("all")).first()
    return 1.0 if not both["all"] else both["got"] / both["all"]
