"""Repeated passages: content-defined chunks of lines and windows of words, removed after comparison.

A line starts after a line break, after the end of a sentence, and at a
capitalised word, so that a passage pasted into the middle of a paragraph has
line starts of its own.  A rolling hash over two neighbouring line hashes
chooses the chunk boundaries: there is one where the two lines before it or the
two lines after it hash to zero modulo ``divisor``, so boundaries depend on
nearby lines alone and survive shifts.  This is done for ``seeds`` choices.

Whole chunks don't lie inside every short passage, so windows of ``GRAM`` words
are candidates as well: of every ``GRAM`` neighbouring windows the one with the
least hash (winnowing).  Every passage of ``2 * GRAM - 1`` = 49 words so holds a
window that is chosen wherever the passage stands, with or without lines, and in
longer passages the chosen windows leave no word between them.

Chunks of several lines, and windows, that occur more than once in the whole
corpus are repeated.  Their hashes alone are counted first; a bitmap of those that
occur twice (8 MB) then leaves all others out before anything else is made of them.
The first occurrence, in the order of (doc_id, place), stays.  What a document
repeats of an earlier one at the same distance, without a gap, is one stretch.  Stretches are compared word by word (white space runs count
as one space) with the words of the earlier text, and extended over equal words, up to ``CONTEXT``
beyond their ends, as longer equal runs hold a window of their own.  They are cut out where
the joined cuts of a document have at least ``min_words`` words.  Only the words
of a stretch travel to the document that repeats it, and one document is compared at a time.

With ``copies`` (a share; off by default) a document that would lose that share of its words
and is about as long as the earlier document that most of them come from is a copy of it: what
comes from there stays, so that near-duplicate detection finds the two alike instead of an empty rest.

Defined cases: null texts stay null and empty ones empty; a null doc_id counts
as the largest id; rows that agree in doc_id and text share one decision; of a
passage that overlaps its own copy the first occurrence stays whole; the rows
and all other columns stay as they are, only ``text`` changes (and ``n_chars``,
where there is such a column).
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import probable_members, with_membership
from .common import bitmap, frames, fresh, mix64, runs, sorted_groups, staged, trim

GRAM = 25
CONTEXT = GRAM - 1
BITS = 26
#: A copy is at least so long as a part of the other document, and the other way round.
ALIKE = 0.8
SUB_BATCH = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _table(test) -> np.ndarray:
    return np.array([test(chr(i)) for i in range(0x10000)] + [False])


UPPER, SPACE = _table(str.isupper), _table(str.isspace)
END = _table(lambda c: c in ".!?…。！？")


def powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLE: list[np.ndarray] = []


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, at least ``n`` of them; up to ``SUB_BATCH`` and some are kept."""
    if not _TABLE or len(_TABLE[0]) < n:
        back = np.full(max(n, SUB_BATCH), pow(int(_P), -1, 1 << 64), np.uint64)
        back[0] = 1
        made = [powers(len(back)), np.multiply.accumulate(back)]
        if n > 4 * SUB_BATCH:
            return made[0], made[1]
        _TABLE[:] = made
    return _TABLE[0], _TABLE[1]


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[:size - width], x[width - size:]) if size < width else x


class Lines:
    """Lines of several texts: ``start``, ``hash``, ``words``; ``first`` of each text.

    ``word`` are the hashes of all words, ``begin`` and ``end`` their places, ``first_word`` the first of each text and
    ``at`` that of each line.
    """

    def __init__(self, texts: list[str]):
        c = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(c, 0x10000)
        self.offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        solid = ~SPACE[at]
        begin = np.flatnonzero(solid & np.r_[True, ~solid[:-1]]) if len(c) else np.empty(0, np.int64)
        self.begin, self.end = begin, np.flatnonzero(solid & np.r_[~solid[1:], True]) + 1 if len(c) else begin
        self.code = c
        self.first_word = np.searchsorted(begin, self.offset)
        n = len(begin)
        if not n:
            self.start = self.hash = self.words = self.word = self.at = np.empty(0, np.int64)
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        # A word starts a line if it is capitalised, follows the end of a sentence or is the first after a line break.
        starts = UPPER[at[begin]]
        starts[1:] |= END[at[begin[1:] - 2]]
        after = np.searchsorted(begin, np.r_[0, np.flatnonzero(c == 10)])
        starts[after[after < n]] = True
        # Letters times the power of their place in the batch; taking the word's place out again leaves that in the word.
        power, back = power_table(len(c))
        value = (c + np.uint32(7)).astype(np.uint64)
        value *= power[:len(c)]
        value *= solid
        self.word = mix64(np.add.reduceat(value, begin) * back[begin])
        self.at = np.flatnonzero(starts)
        self.start = begin[self.at]
        self.words = np.diff(np.r_[self.at, n])
        inside = np.arange(n) - np.repeat(self.at, self.words)
        self.hash = mix64(np.add.reduceat(self.word * powers(int(self.words.max()))[inside], self.at) + self.words.astype(np.uint64) * _P)
        self.first = np.searchsorted(self.start, self.offset)

    def bytes_before(self) -> np.ndarray:
        """Bytes of UTF-8 before each character."""
        size = np.ones(len(self.code) + 1, np.int64)
        for more in (0x80, 0x800, 0x10000):
            size[1:] += self.code >= more
        size[0] = 0
        return np.cumsum(size)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of the chosen windows of words."""
        n = len(self.word) - GRAM + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        power, back = power_table(len(self.word))
        total = np.r_[np.uint64(0), np.cumsum(self.word * power[:len(self.word)], dtype=np.uint64)]
        h = np.minimum(mix64((total[GRAM:] - total[:-GRAM]) * back[:n]), _NONE - np.uint64(1))
        stop = np.repeat(self.first_word[1:], np.diff(self.first_word))
        whole = np.arange(n) + GRAM <= stop[:n]
        h[~whole] = _NONE
        edge = np.full(GRAM - 1, _NONE, np.uint64)
        least = sliding(np.minimum, np.r_[edge, h, edge], GRAM)
        at = np.flatnonzero(whole & (sliding(np.maximum, least, GRAM) == h))
        return at, h[at]

    def chunks(self, seed: int, divisor: int) -> np.ndarray:
        """Whether a chunk starts at each line."""
        h, n = self.hash, len(self.start)
        flag = np.zeros(n, bool)
        if not n:
            return flag
        doc = np.searchsorted(self.first, np.arange(n), "right")
        salt = mix64(np.array([2 * seed + 1, 2 * seed + 2], np.uint64))
        left = mix64((h[:-1] * np.uint64(31) + h[1:]) ^ salt[0])
        right = mix64((h[:-1] * np.uint64(37) + h[1:]) ^ salt[1])
        same = doc[:-1] == doc[1:]
        d = np.uint64(divisor)
        zero_left, zero_right = same & (left % d == 0), same & (right % d == 0)
        flag[2:] |= zero_left[:-1]
        flag[:-1] |= zero_right
        flag[self.first[:-1][self.first[:-1] < n]] = True
        return flag


def candidates(lines: Lines, divisor: int, seeds: int, min_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and hash of the chunks and windows."""
    n = len(lines.start)
    at, h = lines.windows()
    found = [(at, np.full(len(at), GRAM), h)]
    for seed in range(seeds if n else 0):
        at = np.flatnonzero(lines.chunks(seed, divisor))
        size = np.r_[at[1:], n] - at
        keep = size >= min_lines
        index = np.arange(n) - np.repeat(at, size)
        value = mix64(lines.hash + index.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        h = mix64(np.add.reduceat(value, at) + size.astype(np.uint64))
        words = np.add.reduceat(lines.words, at)
        found.append((lines.at[at[keep]], words[keep], h[keep]))
    word, size, h = (np.concatenate(x) for x in zip(*found))
    if seeds > 1:
        # The same chunk by several choices counts once.
        _, one = np.unique(np.stack([word.astype(np.uint64), h]), axis=1, return_index=True)
        word, size, h = word[one], size[one], h[one]
    return word, size, h


def _hashes(divisor: int, seeds: int, min_lines: int):
    def run(batches):
        for b in batches:
            texts = b["text"].tolist()
            for part in runs([len(t) for t in texts], SUB_BATCH):
                h, n = np.unique(candidates(Lines(texts[part]), divisor, seeds, min_lines)[2], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})
        trim()
    return run


def _rows(divisor: int, seeds: int, min_lines: int, marks):
    def run(batches):
        bits = marks.value
        for b in batches:
            ids, tx, texts = b["did"].to_numpy(), b["tx"].to_numpy(), b["text"].tolist()
            for part in runs([len(t) for t in texts], SUB_BATCH):
                lines = Lines(texts[part])
                word, size, h = candidates(lines, divisor, seeds, min_lines)
                at = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                keep = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                if not keep.any():
                    continue
                word, size, h = word[keep], size[keep], h[keep]
                doc = np.searchsorted(lines.first_word, word, "right") - 1
                zero, stop = lines.first_word[doc], lines.first_word[doc + 1]
                left, right = np.maximum(word - CONTEXT, zero), np.minimum(word + size + CONTEXT, stop)
                byte = lines.bytes_before()
                yield pd.DataFrame({"did": ids[part][doc], "tx": tx[part][doc], "word": word - zero, "n": size, "left": left - zero,
                                    "c0": byte[lines.begin[left]] - byte[lines.offset[doc]], "c1": byte[lines.end[right - 1]] - byte[lines.offset[doc]],
                                    "total": stop - zero, "h": h.view(np.int64)})
        trim()
    return run


def cuts(text: str, refs, min_words: int, copies: float | None = None) -> list[tuple[int, int]]:
    """Character ranges of ``text`` to cut, from references to equal earlier words.

    A reference says by how many words the copy lies further on, which word of the earlier text the given words begin with,
    where in it the repeated ones begin and end, how many of them go together at least, whether the copy lies so near to what
    it copies that it isn't extended, which text that is and its number of words (0 for this text itself), and gives the words.
    """
    words = text.split()
    n = len(words)
    found: dict = {}
    for shift, left, a, z, least, near, source, total, piece in refs:
        piece = piece.split()
        spans = found.setdefault((source, total), [])
        i, j = a + shift, z + shift
        if i >= 0 and j <= n and piece[a - left:z - left] == words[i:j] and z - left <= len(piece):
            # The whole stretch is equal, as most are: extend it on both sides.
            if not near:
                k = a - left - 1
                while k >= 0 and i > 0 and piece[k] == words[i - 1]:
                    i, k = i - 1, k - 1
                k = z - left
                while k < len(piece) and j < n and piece[k] == words[j]:
                    j, k = j + 1, k + 1
            spans.append((i, j))
            continue
        zero = max(left, -shift)
        same = np.fromiter(map(str.__eq__, piece[zero - left:], words[zero + shift:]), bool)
        if near:
            same[:max(0, a - zero)] = same[max(0, z - zero):] = False
            least = 1
        edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
        spans += [(i + zero + shift, j + zero + shift) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist())
                  if j - i >= least and i + zero < z and j + zero > a]
    drop = _joined(x for spans in found.values() for x in spans)
    if copies is not None and n and sum(j - i for i, j in drop) >= copies * n:
        (main, total), _ = max(found.items(), key=lambda f: (sum(j - i for i, j in _joined(f[1])), f[0]))
        if min(total, n) >= ALIKE * max(total, n):
            drop = _joined(x for k, spans in found.items() if k != (main, total) for x in spans)
    drop = [(i, j) for i, j in drop if j - i >= min_words]
    if not drop:
        return []
    solid = ~SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)]
    start = np.r_[np.flatnonzero(solid & np.r_[True, ~solid[:-1]]), len(text)].tolist()
    return [(start[i], start[j]) for i, j in drop]


def _joined(spans) -> list[tuple[int, int]]:
    """Spans of words in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for i, j in sorted(spans):
        if out and i <= out[-1][1]:
            if j > out[-1][1]:
                out[-1] = (out[-1][0], j)
        else:
            out.append((i, j))
    return out


def _ranges(min_words: int, copies: float | None):
    def run(batches):
        def out():
            for (did, tx), group in sorted_groups(batches, 2):
                text, refs = None, []
                for _, _, kind, body, *ref in group:
                    if kind:
                        refs.append((*ref, body))
                    else:
                        text = body
                found = cuts(text, refs, min_words, copies) if refs and text is not None else []
                if found:
                    yield did, tx, [{"a": a, "z": z} for a, z in found]
        yield from frames(out(), ["did", "tx", "cuts"], 1000)
        trim()
    return run


def dedup_lines(docs: DataFrame, divisor: int = 3, seeds: int = 1, min_lines: int = 2, min_words: int = 25,
                copies: float | None = None) -> DataFrame:
    """``docs`` with later copies of repeated passages cut out of ``text``."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(sys.maxsize))
    tx = F.xxhash64("text")
    full = docs.filter("text is not null and text <> ''").select(did.alias("did"), tx.alias("tx"), "text")
    # Hashes that occur twice; what occurs once goes no further.
    twice = full.select("text").mapInPandas(_hashes(divisor, seeds, min_lines), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(twice.select(F.pmod("h", F.lit(1 << BITS)).alias("slot")), BITS))
    rows = staged(full.mapInPandas(_rows(divisor, seeds, min_lines, marks),
                                   "did long, tx long, word int, n int, left int, c0 int, c1 int, total int, h long"), "candidates")
    place = F.struct("did", "tx", "word", "n", "left", "c0", "c1", "total")
    first = rows.groupBy("h").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("h", "f")
    later = rows.select("did", "tx", "word", "n", "h").join(first, "h") \
        .filter((F.col("did") != F.col("f.did")) | (F.col("tx") != F.col("f.tx")) | (F.col("word") != F.col("f.word")) | (F.col("n") != F.col("f.n"))) \
        .select("did", "tx", "n", F.col("word").alias("at"), F.col("f.did").alias("fdid"), F.col("f.tx").alias("ftx"), F.col("f.word").alias("a"),
                (F.col("f.word") + F.col("n")).alias("z"), (F.col("word") - F.col("f.word")).alias("shift"), F.col("f.left").alias("left"),
                F.col("f.c0").alias("c0"), F.col("f.c1").alias("c1"), F.col("f.total").alias("total"))
    # Inside one text a copy starts after the end of what it copies.
    own = (F.col("did") == F.col("fdid")) & (F.col("tx") == F.col("ftx"))
    later = later.withColumn("a", F.when(own, F.greatest("a", F.col("z") - F.col("shift"))).otherwise(F.col("a"))).filter("a < z")
    # Candidates that touch or overlap are one stretch.
    apart = ["did", "tx", "fdid", "ftx", "shift"]
    order = Window.partitionBy(*apart).orderBy("a", "z")
    before = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.when(F.col("a") <= before, F.lit(0)).otherwise(F.lit(1))) \
        .withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = staged(later.groupBy(*apart, "stretch")
                   .agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min(F.least("n", F.lit(GRAM))).alias("least"), F.min("left").alias("left"),
                        F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.max("total").alias("total")), "parts")
    # Only documents with a repeated passage are shuffled; the others pass straight through.
    key = F.xxhash64("did", "tx")
    texts = probable_members(full, key, parts, F.xxhash64("fdid", "ftx")).dropDuplicates(["did", "tx"]) \
        .select(F.col("did").alias("fdid"), F.col("tx").alias("ftx"), F.col("text").alias("_text"))
    near = (own & (F.col("shift") < GRAM)).cast("int")
    refs = parts.join(texts, ["fdid", "ftx"]).select(
        "did", "tx", F.lit(1).alias("kind"), F.substring(F.col("_text").cast("binary"), F.col("c0") + 1, F.col("c1") - F.col("c0")).cast("string").alias("text"), "shift", "left", "a", "z",
        "least", near.alias("near"), F.xxhash64("fdid", "ftx").alias("source"), F.when(own, F.lit(0)).otherwise(F.col("total")).alias("total"))
    plain = probable_members(full, key, parts, key).select("did", "tx", F.lit(0).alias("kind"), "text", *[
        F.lit(0).cast("long" if c == "source" else "int").alias(c) for c in refs.columns[4:]])
    found = plain.unionByName(refs).repartition("did", "tx").sortWithinPartitions("did", "tx", "kind") \
        .mapInPandas(_ranges(min_words, copies), "did long, tx long, cuts array<struct<a:int,z:int>>")
    _did, _tx, _hit, _cuts = fresh(docs, "_did", "_tx", "_hit", "_cuts")
    found = found.select(F.col("did").alias(_did), F.col("tx").alias(_tx), F.col("cuts").alias(_cuts))
    keyed = with_membership(docs.withColumn(_did, did).withColumn(_tx, tx), F.xxhash64(_did, _tx), parts, key, _hit)
    # What stays lies from the end of each cut to the beginning of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform(_cuts, lambda c: c["z"]))
    begins = F.concat(F.transform(_cuts, lambda c: c["a"]), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(ends, begins, lambda a, z: F.substring(F.col("text"), a + 1, z - a)), "")
    same = F.col(_cuts).isNull()
    out = keyed.filter(F.col(_hit)).join(found, [_did, _tx], "left").withColumn("text", F.when(same, F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(same, F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return keyed.filter(~F.col(_hit)).select(*docs.columns).unionByName(out.select(*docs.columns))
