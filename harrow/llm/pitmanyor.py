"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are the words of a text (A-Z in lower case) and one end.  A token is
drawn from the restaurant of its context, which is the whole word before it (or
the start of a text).  The parent of a context is the restaurant of its class,
the low six bits of the word's last two bytes, and the parent of these is one
root restaurant over all words, whose base is uniform over the training words
and one unknown.  A dish that opens a table sends a customer to the parent.

Seatings are sampled: a sweep seats the customers of every dish anew, one after
another, each joining a table or opening one with the chance that the Chinese
restaurant process gives it, the rest of the state being that of the sweep
before (blocked Gibbs sampling, all dishes at once).  After the burn-in, the
predictive probabilities of the sweeps are averaged.

How it runs:

* Tasks turn their texts into chunks: distinct (word, context) keys, how often
  each occurs in training texts, and for each token the place of its key.
* The keys go to shards by word hash, so all contexts of a word meet; a hot word
  is spread over the shards by the classes of its contexts.
* A sweep is one pass over the shards.  Of it the next one needs the customers
  and tables of every context, which has dishes in many shards.  Those of
  ``FREQUENT`` words, as a sample of texts finds them, are one array at any corpus
  size, as are the root's customers for the ``HOT`` first of them.  The totals of
  all other contexts are summed by context hash and go back to the shards that
  hold them; a context that lies in one shard alone is known there.  The sample
  only decides which way totals go, it doesn't change them.
* Seatings are a function of the seed, the shard and the totals so far, so that
  a lost task gives the same again.
* Shards send back a probability for each key, and chunks add them up by text.

Words are told apart by 52 bits of hash and their class.

Defined cases: null and empty texts consist of the end alone; a null id counts
as training side; every row is scored on its own; without training rows all
counts are 0 and words have the probability of the uniform base.
"""
from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.staging import hadoop_path
from .common import crc_mod, mix64, runs, scratch, staged, text_of, trim

PARENT_BITS, BYTE_BITS = 12, 6
PARENTS = 1 << PARENT_BITS
CHUNK_TOKENS = 1_500_000
SHARD_KEYS = 500_000
#: Contexts whose totals are kept in one array, words that are spread over shards, and the texts' characters that they are found in.
FREQUENT, HOT = 1 << 18, 1 << 12
SAMPLE_CHARS = 32_000_000
SLICE = 1 << 13
END = np.uint64(0x656E64) << np.uint64(PARENT_BITS)
STRENGTH = 1.0
_P = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _P, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def token_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys (word, word before it) of all tokens of lower-cased texts, and the tokens of each text.

    A word is its hash over its class; the word before the first one is 0.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes + 1)
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    solid = ~_SPACE[buf]
    start = np.flatnonzero(solid & np.r_[True, ~solid[:-1]]) if len(buf) else np.empty(0, np.int64)
    stop = np.flatnonzero(solid & np.r_[~solid[1:], True]) + 1 if len(buf) else start
    n_words = np.diff(np.r_[0, np.searchsorted(start, stops)])
    total = len(start) + len(texts)
    word = np.full(total, END, np.uint64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    at = np.arange(len(start)) + doc
    if len(start):
        size = stop - start
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        value = (buf[solid].astype(np.uint64) + np.uint64(1)) * _powers(int(size.max()))[place]
        h = mix64(np.add.reduceat(value, np.cumsum(size) - size) + size.astype(np.uint64) * _P)
        low = (buf[stop - 1] & 63).astype(np.uint64)
        low2 = np.where(size > 1, buf[np.maximum(stop - 2, 0)] & 63, 0).astype(np.uint64)
        word[at] = (h >> np.uint64(PARENT_BITS)) << np.uint64(PARENT_BITS) | low2 << np.uint64(BYTE_BITS) | low
    before = np.r_[np.uint64(0), word[:-1]]
    before[np.cumsum(n_words + 1) - (n_words + 1)] = 0
    return np.stack([word, before], axis=1), n_words + 1


def class_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(PARENTS - 1)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all first bytes, all second bytes, ..., so that zeros lie together and compress."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unplanes(data, "<u8"), dtype=np.uint64)


def squeeze(x: np.ndarray) -> bytes:
    return zlib.compress(planes(x), 1)


def spread(data: bytes, kind: str) -> np.ndarray:
    return unplanes(zlib.decompress(data), kind)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct whole numbers, ascending, and the place of each of ``x`` among them: ``np.unique`` with half of its memory."""
    order = np.argsort(x)
    x = x[order]
    first = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=first[1:])
    x = x[first]
    rank = np.cumsum(first, dtype=np.int32)
    rank -= 1
    place = np.empty(len(rank), np.int32)
    place[order] = rank
    return x, place


def hash_of(words: np.ndarray) -> np.ndarray:
    """The words' hashes, without their classes."""
    return words >> np.uint64(PARENT_BITS)


class Frequent:
    """Frequent words, the most frequent first; ``code`` is the place of a word's hash among them, or -1."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.order = np.argsort(hash_of(words))
        self.sorted = hash_of(words)[self.order]

    def code(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.words) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)


_NOBODY = Frequent(np.empty(0, np.uint64))


def _words(batches):
    for b in batches:
        texts = b["text"].tolist()
        for part in runs([len(t) for t in texts], 2_000_000):
            keys, _ = token_keys([t.encode("utf-8", "surrogatepass").lower() for t in texts[part]])
            word, n = np.unique(keys[:, 0], return_counts=True)
            yield pd.DataFrame({"word": word.view(np.int64), "n": n})
    trim()


def frequent(rows: DataFrame, chars: int) -> Frequent:
    """The ``FREQUENT`` commonest words in a sample of about ``SAMPLE_CHARS`` characters."""
    apart = max(1, chars // SAMPLE_CHARS)
    some = rows.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(apart)) == 0).select("text")
    top = some.mapInPandas(_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .orderBy(F.desc("n"), "word").limit(FREQUENT).select("word").collect()
    return Frequent(np.array([r["word"] for r in top], np.int64).view(np.uint64))


CHUNK = ("route long, chunk long, shard int, words binary, runs binary, codes binary, others binary, counts binary, "
         "doc_ids array<long>, held array<boolean>, sizes array<int>, places binary")


def _chunks(shards: int, known):
    bits = np.uint64(64 - int(math.log2(shards)))

    def emit(chunk, keys, sizes, ids, held):
        sizes, held = np.concatenate(sizes), np.array(held, bool)
        words, w = np.unique(np.concatenate(keys), return_inverse=True)
        # Contexts in the order of their codes, the others after them; the first of all is the start of a text.
        contexts = np.r_[np.uint64(0), words]
        code = known.value.code(hash_of(contexts))
        hot_word = (code[1:] >= 0) & (code[1:] < HOT)
        order = np.argsort(np.where(code < 0, FREQUENT, code), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        contexts, code = contexts[order], code[order]
        u = np.r_[0, w[:-1] + 1]
        u[np.cumsum(sizes) - sizes] = 0
        uniq, inverse = np.unique(w * len(contexts) + place[u], return_inverse=True)
        del u
        w, u = np.divmod(uniq, len(contexts))
        train = np.bincount(inverse[np.repeat(~held, sizes)], minlength=len(uniq)).astype("<u4")
        shard = shard_of(words[w], contexts[u], hot_word[w], bits)
        order = np.argsort(shard, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        w, u, train, shard = w[order], u[order], train[order], shard[order]
        rows = [(chunk + shards, chunk, -1, *[None] * 5, ids, held.tolist(), sizes.tolist(), squeeze(rank[inverse].astype("<u4")))]
        edge = np.searchsorted(shard, np.arange(shards + 1))
        for s in range(shards):
            a, z = edge[s], edge[s + 1]
            if z > a:
                first = np.flatnonzero(np.diff(w[a:z], prepend=-1))
                c = code[u[a:z]]
                rows.append((s, chunk, s, pack_keys(hash_of(words[w[a:z][first]])), squeeze(np.diff(np.r_[first, z - a]).astype("<u4")),
                             squeeze(np.where(c < 0, FREQUENT, c).astype("<u4")), contexts[u[a:z][c < 0]].astype("<u8").tobytes(),
                             squeeze(train[a:z]), None, None, None, None))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK.split(", ")])

    def run(batches):
        from pyspark import TaskContext
        chunk = TaskContext.get().partitionId() << 32
        keys, sizes, ids, held, n = [], [], [], [], 0
        for b in batches:
            some, number, out = b["doc_id"].notna().tolist(), b["doc_id"].tolist(), b["held_out"].tolist()
            texts = b["text"].tolist()
            del b
            for part in runs([len(t) for t in texts], 300_000):
                k, s = token_keys([t.encode("utf-8", "surrogatepass").lower() for t in texts[part]])
                keys.append(k[:, 0].copy())
                sizes.append(s)
                ids += [int(v) if ok else None for v, ok in zip(number[part], some[part])]
                held += out[part]
                n += len(k)
                if n >= CHUNK_TOKENS:
                    yield emit(chunk, keys, sizes, ids, held)
                    chunk, keys, sizes, ids, held, n = chunk + 1, [], [], [], [], 0
        if keys:
            yield emit(chunk, keys, sizes, ids, held)
        trim()
    return run


def shard_of(words: np.ndarray, contexts: np.ndarray, hot: np.ndarray, bits: np.uint64) -> np.ndarray:
    """Shards by word, of hot words by word and class of the context."""
    h = words.copy()
    h[hot] = mix64(words[hot] ^ (contexts[hot] & np.uint64(PARENTS - 1)) * _P)
    return (h >> bits).astype(np.int64)


def seat(rng: np.random.Generator, customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """Numbers of tables after seating ``customers`` one after another.

    The chance of a new table is ``pull / (pull + seated - discount * tables)``;
    ``pull`` is (strength + discount * tables of the restaurant) times the
    parent's probability of the dish.  From 64 customers on, those of an eighth
    more are seated at the same chance.
    """
    tables = (customers > 0).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    seated = 1
    while len(live):
        step = max(1, seated // 8) if seated >= 64 else 1
        t, a = tables[live], pull[live]
        p = a / (a + seated - discount * t)
        if step == 1:
            tables[live] += rng.random(len(live)) < p
        else:
            tables[live] += rng.binomial(np.minimum(step, customers[live].astype(np.int64) - seated), np.minimum(p, 1.0))
        seated += step
        live = live[customers[live] > seated]
    return tables


def _places(keys: np.ndarray, known: Frequent) -> tuple[np.ndarray, ...]:
    """Hashes of the words, the word of each key, contexts that aren't frequent, and the context of each key, these after the frequent ones."""
    words, word_of = distinct(hash_of(keys[:, 0]))
    u = known.code(hash_of(keys[:, 1]))
    others, rank = distinct(keys[u < 0, 1])
    u[u < 0] = len(known.words) + rank
    return words, word_of, others, u


def _merged(parts, runs_of: list[np.ndarray], known: Frequent) -> tuple[np.ndarray, ...]:
    """The same of the keys that the chunks have in a shard, one chunk after another."""
    words, word = distinct(np.concatenate([unpack_keys(x["words"]) for x in parts]))
    others, rank = distinct(np.concatenate([np.frombuffer(x["others"], "<u8") for x in parts]))
    u = np.concatenate([spread(x["codes"], "<u4") for x in parts]).astype(np.int32)
    u[u == FREQUENT] = len(known.words) + rank
    return words, np.repeat(word, np.concatenate(runs_of)), others, u


class Shard:
    """The restaurants' dishes that fall in one shard; ``us`` are the contexts, the frequent ones first, ``words`` the words."""

    def __init__(self, number: int, keys: np.ndarray | None, counts: np.ndarray, known: Frequent = _NOBODY, places=None):
        self.number = number
        self.words, self.word_of, others, u = places or _places(keys, known)
        self.us = np.r_[known.words, others]
        uniq, self.inverse = distinct(self.word_of.astype(np.int64) * max(1, len(self.us)) + u)
        del places, others, u
        self.c2 = np.bincount(self.inverse, weights=counts, minlength=len(uniq))
        word, u2 = np.divmod(uniq, max(1, len(self.us)))
        self.u2 = u2.astype(np.int32)
        del counts, uniq, u2
        keys1, self.to1 = distinct(word * PARENTS + class_of(self.us)[self.u2])
        self.to0, self.u1 = np.divmod(keys1, PARENTS)
        self.n = len(word), len(keys1), len(self.words)
        self.count = np.bincount(word, weights=self.c2, minlength=self.n[2])
        code = known.code(self.words)
        self.hot = np.flatnonzero((code >= 0) & (code < HOT))
        self.hot_code = code[self.hot]
        # The totals of frequent contexts come in an array, those of the others are asked for.
        self.often = slice(0, len(known.words))
        self.asked = np.arange(len(known.words), len(self.us))
        self.c_own = self.by_context(self.c2)

    def by_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.u2, weights=x, minlength=len(self.us))

    def up(self, t2: np.ndarray) -> np.ndarray:
        return np.bincount(self.to1, weights=t2, minlength=self.n[1])

    def root(self, t1: np.ndarray) -> np.ndarray:
        return np.bincount(self.to0, weights=t1, minlength=self.n[2])

    def asks(self, replies: dict) -> np.ndarray:
        """Contexts whose totals are asked for: all that aren't frequent, from the first reply on those that other shards hold too."""
        return self.asked[replies[0]["many"] > 0] if 0 in replies else self.asked

    def seen(self, history: list[Totals], sweep: int, t2: np.ndarray, replies: dict) -> Totals:
        """The totals of a sweep with those of this shard's contexts."""
        c, t = self.c_own.copy(), self.by_context(t2)
        c[self.often] = history[0].often_c[self.often]
        t[self.often] = history[sweep].often_t[self.often]
        c[self.asked] = replies[0]["c"]
        t[self.asks(replies if sweep else {})] = replies[sweep]["t"]
        return history[sweep].of_shard(c, t)

    def state(self, history: list[Totals], replies: dict) -> tuple[np.ndarray, ...]:
        """Tables ``t2, t1, t0`` after the sweeps that ``history`` has the totals for, and one more."""
        t2 = (self.c2 > 0).astype(float)
        t1 = (self.up(t2) > 0).astype(float)
        t0 = (self.root(t1) > 0).astype(float)
        for sweep in range(len(history)):
            t2, t1, t0 = self.swept(t2, t1, t0, self.seen(history, sweep, t2, replies), sweep)
        return t2, t1, t0

    def swept(self, t2, t1, t0, total: Totals, sweep: int) -> tuple[np.ndarray, ...]:
        p0, p1 = self.above(t2, t1, t0, total)
        rng = np.random.default_rng([20240601, sweep, self.number])
        d = total.discount
        t2 = seat(rng, self.c2, (STRENGTH + d[2] * total.t2[self.u2]) * p1[self.to1], d[2])
        t1 = seat(rng, self.up(t2), (STRENGTH + d[1] * total.t1[self.u1]) * p0[self.to0], d[1])
        return t2, t1, seat(rng, self.root(t1), np.full(self.n[2], total.pull0()), d[0])

    def above(self, t2, t1, t0, total: Totals) -> tuple[np.ndarray, np.ndarray]:
        """Predictive probabilities in the root and the parents."""
        c1, c0 = self.up(t2), self.root(t1)
        if len(self.hot):
            t0 = t0.copy()
            c0[self.hot], t0[self.hot] = total.hot_c[self.hot_code], total.hot_t[self.hot_code]
        d, s = total.discount, STRENGTH
        p0 = (np.maximum(c0 - d[0] * t0, 0) + total.pull0()) / (s + total.c0)
        p1 = (np.maximum(c1 - d[1] * t1, 0) + (s + d[1] * total.t1[self.u1]) * p0[self.to0]) / (s + total.c1[self.u1])
        return p0, p1

    def chances(self, t2, t1, t0, total: Totals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Predictive probabilities in the root, the parents and the contexts."""
        p0, p1 = self.above(t2, t1, t0, total)
        d, s = total.discount, STRENGTH
        p2 = (np.maximum(self.c2 - d[2] * t2, 0) + (s + d[2] * total.t2[self.u2]) * p1[self.to1]) / (s + total.c2[self.u2])
        return p0, p1, p2


FIELDS = ("c", "t", "d", "ones", "twos")


def _five(c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, ...]:
    return c, t, c > 0, c == 1, c == 2


class Sums:
    """What the shards of a task add to the totals, as one vector: see ``PARTS``."""

    PARTS = {"often_c": FREQUENT, "often_t": FREQUENT, "hot_c": HOT, "hot_n": HOT, "level1": 5 * PARENTS, "level2": 5, "level0": 5}
    SIZE = sum(PARTS.values())

    def __init__(self, vector: np.ndarray | None = None):
        self.vector = np.zeros(self.SIZE) if vector is None else vector
        at = 0
        for name, size in self.PARTS.items():
            setattr(self, name, self.vector[at:at + size])
            at += size

    def add(self, x: Shard, t2, t1, t0) -> None:
        self.often_c[x.often] += x.c_own[x.often]
        self.often_t[x.often] += x.by_context(t2)[x.often]
        c0 = x.root(t1)
        self.hot_c[x.hot_code] += c0[x.hot]
        self.hot_n[x.hot_code] += x.count[x.hot]
        cool = np.ones(x.n[2], bool)
        cool[x.hot] = False
        self.level2 += [float(np.sum(v)) for v in _five(x.c2, t2)]
        self.level0 += [float(np.sum(v[cool])) for v in _five(c0, t0)]
        for out, v in zip(self.level1.reshape(5, PARENTS), _five(x.up(t2), t1)):
            out += np.bincount(x.u1, weights=v.astype(float), minlength=PARENTS)


class Totals:
    """Customers and tables of all restaurants, discounts, and the size of the training text.

    ``c2`` and ``t2`` are those of contexts: of all (by rows), or of one shard's.
    """

    often_c = often_t = hot_c = hot_t = hot_n = np.empty(0)

    def __init__(self, rows):
        by = {(r["level"], r["u"]): r for r in rows}

        def column(level, size, name):
            out = np.zeros(size)
            for (lv, u), r in by.items():
                if lv == level:
                    out[u] = r[name]
            return out

        contexts = 1 + max((u for lv, u in by if lv == 2), default=0)
        self.c2, self.t2 = column(2, contexts, "c"), column(2, contexts, "t")
        self.c1, self.t1 = column(1, PARENTS, "c"), column(1, PARENTS, "t")
        self._settle([[sum(r[f] for (lv, _), r in by.items() if lv == k) for f in FIELDS] for k in range(3)])

    def _settle(self, levels) -> None:
        self.c0, self.t0 = float(levels[0][0]), float(levels[0][1])
        self.tokens, self.words = int(round(levels[2][0])), int(round(levels[0][2]))
        self.base = 1.0 / (self.words + 1)
        self.discount = [min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for *_, a, b in levels]

    def pull0(self) -> float:
        return (STRENGTH + self.discount[0] * self.t0) * self.base

    def of_shard(self, c2: np.ndarray, t2: np.ndarray) -> Totals:
        out = object.__new__(Totals)
        out.__dict__.update(self.__dict__, c2=c2, t2=t2)
        return out

    @classmethod
    def of(cls, sums: Sums, history: list[Totals]) -> Totals:
        """Totals after a sweep; the hot words' customers in the root are seated here."""
        self = object.__new__(cls)
        self.often_c, self.often_t, self.hot_c, self.hot_n = (x.copy() for x in (sums.often_c, sums.often_t, sums.hot_c, sums.hot_n))
        if history:
            self.often_c = history[0].often_c
            rng = np.random.default_rng([20240601, len(history) - 1, 1 << 40])
            self.hot_t = seat(rng, self.hot_c, np.full(HOT, history[-1].pull0()), history[-1].discount[0])
        else:
            self.hot_t = (self.hot_c > 0).astype(float)
        level1 = sums.level1.reshape(5, PARENTS)
        self.c1, self.t1 = level1[0].copy(), level1[1].copy()
        hot = [float(np.sum(v)) for v in _five(self.hot_c, self.hot_t)]
        self._settle([(sums.level0 + hot).tolist(), level1.sum(axis=1).tolist(), sums.level2.tolist()])
        return self


def _each(batches, known):
    """Chunks, keys of each of their words, and the shard, of rows that hold the keys of one shard and some chunks, and its replies."""
    for b in batches:
        rows = b.to_dict("records")[::-1]
        del b
        while rows:
            row = rows.pop()
            runs_of = [spread(x["runs"], "<u4") for x in row["x"]]
            shard = Shard(int(row["shard"]), None, np.concatenate([spread(x["counts"], "<u4") for x in row["x"]]), known,
                          _merged(row["x"], runs_of, known))
            replies: dict = {}
            for r in sorted(row["replies"] if row["replies"] is not None else [], key=lambda r: (r["sweep"], r["at"])):
                got = replies.setdefault(r["sweep"], {"c": [], "t": [], "many": []})
                for name, kind in (("c", "<u4"), ("t", "<u4"), ("many", "u1")):
                    if r[name] is not None:
                        got[name].append(spread(r[name], kind).astype(float))
            replies = {k: {name: np.concatenate([np.empty(0), *x]) for name, x in got.items()} for k, got in replies.items()}
            chunks = [x["chunk"] for x in row["x"]]
            del row
            yield chunks, runs_of, shard, replies
            # The next shard is built when this one is gone.
            del chunks, runs_of, shard, replies
            trim()


PASS = "kind int, at int, shard int, ids binary, c binary, t binary"


def _no_replies(sweeps: int, replies: dict) -> dict:
    """A shard that asked for nothing got no reply."""
    return {k: replies.get(k, dict.fromkeys(("c", "t", "many"), np.empty(0))) for k in range(sweeps)}


def _sweep(known, past, bits: int):
    """Sums (kind 1) by slices, and customers and tables of the contexts asked for (kind 0), by context hash."""
    def run(batches):
        history, sums = past.value, Sums()
        for _, _, x, replies in _each(batches, known.value):
            replies = _no_replies(len(history), replies)
            t2, t1, t0 = x.state(history, replies)
            sums.add(x, t2, t1, t0)
            mine = x.asks(replies)
            c, t = x.c_own[mine].astype("<u4"), x.by_context(t2)[mine].astype("<u4")
            at, ids = (x.us[mine] >> np.uint64(64 - bits)).astype(np.int64), hash_of(x.us[mine])
            edge = np.searchsorted(at, np.arange((1 << bits) + 1))
            yield pd.DataFrame([(0, k, x.number, pack_keys(ids[a:z]), None if history else squeeze(c[a:z]), squeeze(t[a:z]))
                                for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist())) if z > a],
                               columns=["kind", "at", "shard", "ids", "c", "t"])
            del x, replies, t2, t1, t0, mine, c, t, at, ids
        yield pd.DataFrame([(1, k, -1, None, None, squeeze(sums.vector[i:i + SLICE].astype("<i8")))
                            for k, i in enumerate(range(0, Sums.SIZE, SLICE)) if sums.vector[i:i + SLICE].any()],
                           columns=["kind", "at", "shard", "ids", "c", "t"])
    return run


def _add_slices(batches):
    for b in batches:
        for at, ts in zip(b["at"], b["ts"]):
            total = 0
            for t in ts:
                total = total + spread(t, "<i8")
            yield pd.DataFrame({"at": [at], "t": [squeeze(total)]})


def _reply(sweep: int):
    """Totals of each context over the shards that sent it, to each of them."""
    def run(batches):
        for b in batches:
            for at, asks in zip(b["at"], b["asks"]):
                ids = [unpack_keys(r["ids"]) for r in asks]
                stops = np.cumsum([len(i) for i in ids])[:-1]
                inverse = distinct(np.concatenate(ids))[1]
                del ids
                out = {"sweep": sweep, "at": at, "shard": [r["shard"] for r in asks], "c": None, "many": None}
                for name in ("c", "t"):
                    if asks[0][name] is not None:
                        total = np.bincount(inverse, weights=np.concatenate([spread(r[name], "<u4") for r in asks]))[inverse]
                        out[name] = [squeeze(x) for x in np.split(total.astype("<u4"), stops)]
                if out["c"]:
                    out["many"] = [squeeze(x) for x in np.split((np.bincount(inverse)[inverse] > 1).astype("u1"), stops)]
                yield pd.DataFrame(out)
        trim()
    return run


def _answers(known, past, burn_in, shards):
    """For each chunk the log10 probabilities of its keys, and how often its words occur."""
    def run(batches):
        history = past.value
        for chunks, runs_of, x, replies in _each(batches, known.value):
            replies = _no_replies(len(history), replies)
            p = np.zeros(x.n[0])
            t2, t1, t0 = x.state([], replies)
            for sweep in range(len(history)):
                total = x.seen(history, sweep, t2, replies)
                if sweep > burn_in:
                    p += x.chances(t2, t1, t0, total)[2]
                if sweep + 1 < len(history):
                    t2, t1, t0 = x.swept(t2, t1, t0, total, sweep)
            p /= max(1, len(history) - 1 - burn_in)
            logs = np.log10(p).astype("<f4")[x.inverse]
            x.count[x.hot] = history[0].hot_n[x.hot_code]
            times = x.count.astype("<u4")[x.word_of]
            at, rows = 0, []
            for chunk, run in zip(chunks, runs_of):
                n = int(run.sum())
                rows.append((chunk + shards, x.number, planes(logs[at:at + n]), squeeze(times[at + np.cumsum(run) - run]), squeeze(run)))
                at += n
            yield pd.DataFrame(rows, columns=["route", "shard", "logs", "known", "runs"])
            del x, replies, t2, t1, t0, total, p, logs, times, rows, runs_of
    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _add_up(total: Totals):
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                row = b.iloc[i]
                answers = sorted(row["answers"], key=lambda r: r["shard"])
                logs = np.concatenate([unplanes(r["logs"], "<f4") for r in answers]).astype(float)
                known = np.concatenate([np.repeat(spread(r["known"], "<u4"), spread(r["runs"], "<u4")) for r in answers]).astype(np.int64)
                place = spread(row["places"], "<u4")
                sizes = np.asarray(row["sizes"], np.int64)
                first = np.cumsum(sizes) - sizes
                base = np.log10(known + 1.0) - math.log10(total.tokens + total.words + 1)
                yield pd.DataFrame({
                    "doc_id": pd.array(list(row["doc_ids"]), "Int64"), "held_out": list(row["held"]), "n_tokens": sizes,
                    "n_known": np.add.reduceat((known > 0)[place].astype(np.int64), first), "train_tokens": total.tokens,
                    "base_score": np.add.reduceat(base[place], first), "score": np.add.reduceat(logs[place], first)})
        trim()
    return run


def lm_scores(docs: DataFrame, sweeps: int = 3, burn_in: int = 1, held_out=None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out`` tells the rows that the model doesn't learn from; by default
    those whose crc32 of the id modulo 7 is 2.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"),
                       (crc_mod("doc_id", 7) == 2 if held_out is None else held_out).alias("held_out"))
    chars = rows.agg(F.sum(F.length("text").cast("long")).alias("n")).first()["n"] or 0
    shards = 1 << max(3, math.ceil(math.log2(max(1, chars / 15 / SHARD_KEYS))))
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(frequent(rows.filter("not held_out"), chars))
    # One shuffle deals the keys to their shards and the texts to where the answers for their chunks will come; what doesn't fit
    # into memory is read from its files again.  As many
    # partitions as shards: those of a partition reach a worker together.
    dealt = rows.mapInPandas(_chunks(shards, known), CHUNK).repartition(shards, "route").persist(StorageLevel.MEMORY_ONLY)
    parts = ["chunk", "words", "runs", "codes", "others", "counts"]
    keyed = dealt.filter("shard >= 0").groupBy("route").agg(F.first("shard").alias("shard"), F.sort_array(F.collect_list(F.struct(*parts))).alias("x"))
    bits = max(3, int(math.log2(shards)) - 4)
    history: list[Totals] = []
    replies: list[DataFrame] = []

    def with_replies() -> DataFrame:
        if not replies:
            return keyed.withColumn("replies", F.lit(None).cast("array<struct<sweep:int,at:int,c:binary,t:binary,many:binary>>"))
        past = replies[0]
        for r in replies[1:]:
            past = past.unionByName(r)
        past = past.select(F.col("shard").cast("long").alias("route"), F.struct("sweep", "at", "c", "t", "many").alias("r")) \
            .repartition(shards, "route").groupBy("route").agg(F.collect_list("r").alias("replies"))
        return keyed.join(past.hint("shuffle_hash"), "route", "left")

    for sweep in range(sweeps + 1):
        folder = scratch(docs.sparkSession, "sweep")
        with_replies().mapInPandas(_sweep(known, sc.broadcast(list(history)), bits), PASS).write.parquet(folder)
        done = docs.sparkSession.read.schema(PASS).parquet(folder)
        vector = np.zeros(Sums.SIZE)
        for r in done.filter("kind = 1").groupBy("at").agg(F.collect_list("t").alias("ts")).mapInPandas(_add_slices, "at int, t binary").collect():
            part = spread(bytes(r["t"]), "<i8")
            vector[r["at"] * SLICE:r["at"] * SLICE + len(part)] = part
        replies.append(staged(done.filter("kind = 0").groupBy("at").agg(F.collect_list(F.struct("shard", "ids", "c", "t")).alias("asks"))
                              .mapInPandas(_reply(sweep), "sweep int, at int, shard int, c binary, many binary, t binary"), "replies"))
        history.append(Totals.of(Sums(vector), history))
        # The sums and the replies hold all that is wanted of it.
        store, path = hadoop_path(docs.sparkSession, folder)
        store.delete(path, True)
    total = history[0]
    answers = with_replies().mapInPandas(_answers(known, sc.broadcast(history), burn_in, shards), "route long, shard int, logs binary, known binary, runs binary") \
        .repartition(shards, "route").groupBy("route").agg(F.collect_list(F.struct("shard", "logs", "known", "runs")).alias("answers"))
    texts = dealt.filter("shard < 0").select("route", "doc_ids", "held", "sizes", "places")
    scores = staged(texts.join(answers, "route").mapInPandas(_add_up(total), SCORES), "scores")
    dealt.unpersist()
    return scores
