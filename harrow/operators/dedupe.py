"""Near-duplicate clustering of programme rows across all targets.

Rows are taken in row order (``row_idx``); each row joins the first earlier
group whose *leader* has the same URL block (netloc, path without trailing
'/') and a name key similar enough (``SequenceMatcher(None, new, leader)
.ratio() >= threshold``), else it starts a group.  Group numbers count every
group, singletons included, in order of their leaders.

Spark plan:

1. name key and block key as native expressions;
2. equal ``(block, key)`` rows collapse to their first row (``min(row_idx)``,
   partially aggregated map-side, so thousands of copies of one row never reach
   a single task) — equal keys always end in the same group;
3. a block with one distinct key needs no comparison; the keys of other blocks
   find their leaders in rounds, each over four times the keys of the one before
   (:func:`leaders_of`).  Keys are compared tile by tile: tiles hold keys of one
   block and length class, only classes that can be similar meet, and a matrix of
   character counts gives the ratio's upper bound before any ratio is computed;
4. leaders get their global ordinal from per-bucket counts and offsets (no
   single-partition window over the rows); a group's first row is its leader,
   so Primary/Duplicate needs no window over a (possibly huge) group.
"""
from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DUPLICATE_STOP_WORDS
from ..functions.ordinal import bucket_ordinal, rank_in_pieces
from ..functions.staging import staged
from ..functions.urls import block_path, netloc, normalise_url


def name_key(name: Column) -> Column:
    """lower, drop ``http(s)://``, non ``[a-z0-9]`` runs -> space, drop stop words."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "https?://", ""),
                              "[^a-z0-9]+", " ")
    words = F.filter(F.split(F.trim(spaced), " ", -1),
                     lambda w: (w != "") & ~w.isin(*DUPLICATE_STOP_WORDS))
    return F.array_join(words, " ")


def block_key(url: Column) -> Column:
    """``struct(netloc, path)`` of the normalised URL; NULL for an empty URL."""
    def body(u):
        return F.when(u != "", F.struct(netloc(u).alias("netloc"), block_path(u).alias("path")))
    from ..functions.text import let
    return let(F.when(F.coalesce(url, F.lit("")) != "", normalise_url(url)).otherwise(F.lit("")), body)


def global_ordinal(df: DataFrame, key: str, bucket_width: int, out: str = "ordinal") -> DataFrame:
    """1-based rank of a unique numeric ``key`` over the whole frame."""
    return bucket_ordinal(df, key, out, width=bucket_width)


TILE = 1 << 10
#: A task compares about so many pairs of keys, more where there would be over ``MOST_PARTS`` tasks.
PAIRS_PER_PART = 1 << 22
#: A pair of tiles costs as much as so many pairs of keys, beside its own.
PAIRS_FOR_A_TILE = 1 << 17
MOST_PARTS = 1 << 11
RANKS_PER_PIECE = 1 << 16
#: So many edges of a block are settled by one ordered scan; more are thinned out first.
EDGES_PER_SCAN = 1 << 20


def _char_counts(keys: list[str], codes: dict[str, int], kind) -> np.ndarray:
    out = np.zeros((len(codes), len(keys)), kind)
    for i, k in enumerate(keys):
        for c in k:
            if c in codes:
                out[codes[c], i] += 1
    return out


def may_be_similar(keys: list[str], leaders: list[str], threshold: float) -> np.ndarray:
    """Matrix of the pairs whose ratio's upper bounds (lengths, then character counts) reach the threshold."""
    lk, ll = np.array([len(k) for k in keys])[:, None], np.array([len(k) for k in leaders])[None, :]
    least = threshold * (lk + ll)
    fits = 2.0 * np.minimum(lk, ll) >= least
    if fits.any():
        kind = np.uint8 if max(lk.max(), ll.max()) < 256 else np.uint32
        codes = {c: i for i, c in enumerate(sorted(set("".join(keys)) & set("".join(leaders))))}
        common = np.zeros(fits.shape, kind)
        for x, y in zip(_char_counts(keys, codes, kind), _char_counts(leaders, codes, kind)):
            common += np.minimum(x[:, None], y[None, :])
        fits &= 2.0 * common >= least
        i, j = np.nonzero(fits)
        length = common_length(keys, leaders, i, j)
        known = length >= 0
        fits[i[known], j[known]] = (2.0 * length / np.maximum(lk[i, 0] + ll[0, j], 1) >= threshold)[known]
    return fits


def common_length(keys: list[str], leaders: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``keys[i]`` and ``leaders[j]``, -1 for keys of over 64 letters.

    Matching blocks are a common subsequence, so it bounds what they sum up to.
    One bit stands for a letter of the key; a step takes the next letter of all leaders.
    """
    codes = {c: n for n, c in enumerate(sorted(set("".join(keys))))}
    short = np.array([len(k) <= 64 for k in keys])
    masks = np.zeros((len(keys), len(codes) + 1), np.uint64)
    for n in np.unique(i[short[i]]).tolist():
        for at, c in enumerate(keys[n]):
            masks[n, codes[c]] |= np.uint64(1 << at)
    out = np.full(len(i), -1, np.int64)
    some = np.flatnonzero(short[i])
    if len(some):
        used, place = np.unique(j[some], return_inverse=True)
        letters = np.full((max(1, max(len(leaders[n]) for n in used)), len(used)), len(codes), np.int64)
        for n, leader in enumerate(used.tolist()):
            letters[:len(leaders[leader]), n] = [codes.get(c, len(codes)) for c in leaders[leader]]
        open_ = np.full(len(some), ~np.uint64(0))
        for step in letters:
            hit = open_ & masks[i[some], step[place]]
            open_ = (open_ + hit) | (open_ - hit)
        out[some] = np.bitwise_count(~open_)
    return out


def _compare(threshold: float, every: bool):
    """Similar pairs of a tile of keys and a tile of earlier leaders: all of them, or the first leader of each key."""
    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("rep", kind="stable")
        keys, reps = left["key"].tolist(), left["rep"].to_numpy(np.int64)
        leaders, lreps = right["key"].tolist(), right["rep"].to_numpy(np.int64)
        fits = may_be_similar(keys, leaders, threshold) & (lreps[None, :] < reps[:, None])
        found, settled = [], np.zeros(len(keys), bool)
        for j in np.flatnonzero(fits.any(axis=0)):
            matcher = SequenceMatcher(None, "", leaders[j])
            for i in np.flatnonzero(fits[:, j] & ~settled):
                matcher.set_seq1(keys[i])
                if matcher.ratio() >= threshold:
                    found.append((reps[i], lreps[j]))
                    settled[i] = not every
        return pd.DataFrame(found, columns=["rep", "leader"]).astype({"rep": "int64", "leader": "int64"})
    return compare


def _tiled(keys: DataFrame, threshold: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """Keys with their length class ``_c`` and tile ``_s``, and how many tiles ``_m`` and keys ``_k`` each class of a block has."""
    block = ["bnet", "bpath"]
    # Similar keys differ in length by a factor of at most (2 - t) / t, so they lie in the same class or in neighbours.
    width = math.log((2 - threshold) / threshold) * (1 + 1e-9)
    keys = keys.withColumn("_c", F.floor(F.log(F.length("key").cast("double")) / F.lit(width)).cast("int"))
    sizes = keys.groupBy(*block, "_c").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("_m"), F.count(F.lit(1)).alias("_k"))
    return keys.join(sizes, [*block, "_c"]).withColumn("_s", F.pmod(F.xxhash64("key"), F.col("_m")).cast("int")).drop("_m", "_k"), sizes


def similar_pairs(keys: DataFrame, leaders: DataFrame, threshold: float, every: bool, tile: int = TILE) -> DataFrame:
    """``(rep, leader)``: keys and the earlier ``leaders`` of their block that they are similar to, or the first of a tile."""
    block = ["bnet", "bpath"]
    left, lsize = _tiled(keys, threshold, tile)
    right, rsize = _tiled(leaders, threshold, tile)
    meet = lsize.select(*block, "_c", (F.col("_k") / F.col("_m")).alias("_w"), F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_s")) \
        .join(rsize.select(*block, F.col("_c").alias("_c2"), (F.col("_k") / F.col("_m")).alias("_w2"),
                           F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_s2")), block) \
        .filter(F.abs(F.col("_c") - F.col("_c2")) <= 1)
    meet = staged(meet, "tiles")
    by = [*block, "_c", "_s", "_c2", "_s2"]
    # A number of our own: tiles are small in bytes, so that Spark would put hundreds of pairs of them in one task.
    work = meet.agg(F.sum(F.col("_w") * F.col("_w2") + PAIRS_FOR_A_TILE).alias("w")).first()["w"] or 0
    parts = max(1, min(math.ceil(work / PAIRS_PER_PART), MOST_PARTS))
    meet = meet.select(*by)
    left = left.join(meet, [*block, "_c", "_s"]).select(*by, "key", "rep")
    right = right.withColumnRenamed("_c", "_c2").withColumnRenamed("_s", "_s2").join(meet, [*block, "_c2", "_s2"]) \
        .select(*[F.col(c).alias(c) for c in (*by, "key", "rep")])  # columns of its own, also where both sides are one table
    left, right = (side.repartition(parts, *[F.col(c) for c in by]) for side in (left, right))
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_compare(threshold, every), "rep long, leader long")


def _first_come(pdf: pd.DataFrame) -> pd.DataFrame:
    """Follow the order of a block's edges: a key without an earlier leader beside it is a leader."""
    pdf = pdf.sort_values(["rep", "earlier"], kind="stable")
    follows: set[int] = set()
    found = []
    for rep, earlier in zip(pdf["rep"].tolist(), pdf["earlier"].tolist()):
        if rep not in follows and earlier not in follows:
            follows.add(rep)
            found.append(rep)
    return pd.DataFrame({"rep": found}, dtype="int64")


def settled_keys(keys: DataFrame, threshold: float, tile: int = TILE, scan: int = EDGES_PER_SCAN) -> DataFrame:
    """Leaders of ``keys`` among themselves: ``(rep, leader)``, a leader's own being itself.

    The leaders are the first maximal independent set, in order, of the graph
    of similar keys.  Rounds over all tasks take those without an earlier
    undecided neighbour for leaders and drop their neighbours, while a block has
    more than ``scan`` edges; what is left of it one ordered scan settles.
    """
    pairs = staged(similar_pairs(keys, keys, threshold, True, tile).select("rep", F.col("leader").alias("earlier")), "edges")
    left = pairs.join(keys.select("rep", "bnet", "bpath"), "rep")
    followers = None
    while True:
        busy = left.groupBy("bnet", "bpath").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > scan)
        if busy.isEmpty():
            break
        # Keys that no undecided earlier key stands beside lead; what stands beside them follows.
        leads = left.select(F.col("earlier").alias("rep")).distinct().join(left.select("rep").distinct(), "rep", "left_anti")
        follow = staged(left.join(leads.select(F.col("rep").alias("earlier")), "earlier").select("rep").distinct(), "followers")
        followers = follow if followers is None else followers.unionByName(follow)
        gone = follow.unionByName(leads)
        left = left.join(gone, "rep", "left_anti").join(gone.select(F.col("rep").alias("earlier")), "earlier", "left_anti")
        left = staged(left, "edges")
    last = left.groupBy("bnet", "bpath").applyInPandas(_first_come, "rep long")
    followers = staged(last if followers is None else followers.unionByName(last), "followers")
    of = pairs.join(followers, "rep").join(followers.select(F.col("rep").alias("earlier")), "earlier", "left_anti") \
        .groupBy("rep").agg(F.min("earlier").alias("leader"))
    return keys.select("rep").join(of, "rep", "left").withColumn("leader", F.coalesce("leader", "rep"))


def leaders_of(keys: DataFrame, threshold: float, batch: int = 256, tile: int = TILE, scan: int = EDGES_PER_SCAN) -> DataFrame:
    """``keys(bnet, bpath, key, rep)``, distinct keys of each block -> the same with ``leader``.

    In rounds: of the keys that are still open, those among the first ``batch``
    of their block (then four times as many, and so on) are settled among
    themselves, and the later ones try the new leaders.  A key's leader is the first of
    the earlier leaders that it is similar to, as in a serial scan; a block of n
    keys takes log4(n / batch) rounds, and a task sees two tiles at a time.
    """
    block = ["bnet", "bpath"]
    left = staged(rank_in_pieces(keys, block, [F.floor(F.col("rep") / RANKS_PER_PIECE)], ["rep"], "_n"), "ranked")
    done = None
    while True:
        now = staged(left.filter(F.col("_n") <= batch), "batch")
        settled = staged(settled_keys(now, threshold, tile, scan), "settled")
        done = settled if done is None else done.unionByName(settled)
        rest = left.filter(F.col("_n") > batch)
        if rest.isEmpty():
            return keys.join(done, "rep").select(*block, "key", "rep", "leader")
        fresh = now.join(settled.filter("rep = leader").select("rep"), "rep")
        tried = staged(similar_pairs(rest, fresh, threshold, False, tile).groupBy("rep").agg(F.min("leader").alias("leader")), "tried")
        done = done.unionByName(tried)
        left = staged(rest.join(tried, "rep", "left_anti").select(*left.columns), "open")
        batch *= 4


def assign_groups(rows: DataFrame, threshold: float | None, bucket_width: int = 1 << 16, batch: int = 256) -> DataFrame:
    """``rows(row_idx, name, url, ...)`` -> adds ``duplicate_group, duplicate_status``.

    ``threshold=None`` is the native variant: only equal name keys in a block
    are duplicates (the similarity scan is skipped).
    """
    keyed = rows.withColumn("_key", name_key(F.col("name"))).withColumn("_blk", block_key(F.col("url")))
    keyed = keyed.withColumn("_eligible", (F.col("_key") != "") & F.col("_blk").isNotNull())
    elig = keyed.filter("_eligible").select(
        "row_idx", F.col("_key").alias("key"), F.col("_blk.netloc").alias("bnet"), F.col("_blk.path").alias("bpath"))
    if threshold is None or threshold >= 1.0:
        elig = elig.withColumn("key", F.sha2("key", 256))  # equality alone: keys can be whole texts
    reps = elig.groupBy("bnet", "bpath", "key").agg(F.min("row_idx").alias("rep"))
    if threshold is None or threshold >= 1.0:
        leader_of = reps.withColumnRenamed("rep", "leader")
    else:
        # A block with one key needs no comparison.
        sizes = reps.groupBy("bnet", "bpath").agg(F.count(F.lit(1)).alias("_nk"))
        reps = staged(reps.join(sizes, ["bnet", "bpath"]), "keys")
        single = reps.filter("_nk = 1").select("bnet", "bpath", "key", F.col("rep").alias("leader"))
        multi = reps.filter("_nk > 1").drop("_nk")
        leader_of = single if multi.isEmpty() else single.unionByName(leaders_of(multi, threshold, batch).drop("rep"))
    member = elig.join(leader_of, ["bnet", "bpath", "key"]).select("row_idx", "leader")
    # Labels are made on narrow rows; the rows themselves meet them once, at the end.
    with_leader = rows.select("row_idx").join(member, "row_idx", "left") \
        .withColumn("_leader", F.coalesce(F.col("leader"), F.col("row_idx"))).drop("leader")
    leaders = with_leader.filter(F.col("_leader") == F.col("row_idx")).select(F.col("row_idx").alias("_lid"))
    numbered = global_ordinal(leaders, "_lid", bucket_width, "_group_no")
    # Group sizes by partial aggregation; the one-row-per-leader info is then
    # joined back (AQE splits a hot leader's rows across tasks).
    sizes = with_leader.groupBy("_leader").agg(F.count(F.lit(1)).alias("_size"))
    info = numbered.join(sizes, numbered["_lid"] == sizes["_leader"]).drop("_lid")
    labels = with_leader.join(info, "_leader").withColumn(
        "duplicate_group", F.when(F.col("_size") > 1, F.format_string("DUP-%03d", F.col("_group_no"))).otherwise(F.lit(""))
    ).withColumn(
        "duplicate_status",
        F.when(F.col("_size") == 1, F.lit("Unique")).when(F.col("row_idx") == F.col("_leader"), F.lit("Primary"))
        .otherwise(F.lit("Duplicate"))
    ).select("row_idx", "duplicate_group", "duplicate_status")
    return rows.join(labels, "row_idx")


def mark_duplicates(programmes: DataFrame, threshold: float | None, bucket_width: int = 1 << 16) -> DataFrame:
    """Programme rows with duplicate labels; duplicates go back to review."""
    rows = programmes.drop("duplicate_group", "duplicate_status") \
        .withColumn("name", F.col("programme_name")).withColumn("url", F.col("source_url"))
    out = assign_groups(rows, threshold, bucket_width).drop("name", "url")
    return out.withColumn("review_status", F.when(F.col("duplicate_status") == "Duplicate", F.lit("Needs human review"))
                          .otherwise(F.col("review_status")))
