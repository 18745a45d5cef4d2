import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import flatgraph, packing, pitmanyor

from .util import DOCS, docs, odd_rows, words

VECTORS = "vec_id long, embedding array<float>, label int"


def clouds(seed, n=300, dim=12):
    rng = np.random.default_rng(seed)
    rows, centers = [], rng.normal(size=(20, dim))
    for i in range(n):
        v = centers[rng.integers(20)] + rng.normal(size=dim) * rng.choice([0.05, 0.3, 3.0])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(n + i, rows[7][1], 1) for i in range(15)]
    rows += [(n + 100, [2 * x for x in rows[7][1]], 1)]
    return rows


def brute(rows, t=0.9):
    ids = [i for i, _, _ in rows]
    x = flatgraph.unit_rows(np.array([v for _, v, _ in rows]))
    s = x @ x.T >= t
    np.fill_diagonal(s, False)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(s)):
        p, q = sorted((find(a), find(b)), key=lambda k: ids[k])
        root[q] = p
    return {ids[k]: (int(s[k].sum()), ids[find(k)]) for k in range(len(ids))}


@pytest.mark.parametrize("shard_rows", [2000, 40])
def test_links_equal_brute_force(spark, shard_rows):
    rows = clouds(3)
    df = spark.createDataFrame(rows, VECTORS)
    out = flatgraph.near_vectors(df, shard_rows=shard_rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()}
    want = brute(rows)
    if shard_rows == 2000:
        assert got == want
    else:
        # Twenty small shards: a link may lie between shards that do not overlap, never is one made up.
        assert all(got[i][0] <= want[i][0] for i in want)
        assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert flatgraph.recall(df, out) >= 0.9


def test_a_dense_group_is_split_without_loss(spark):
    rng = np.random.default_rng(5)
    c = rng.normal(size=16)
    rows = [(i, [float(x) for x in c + rng.normal(size=16) * 0.1], 0) for i in range(260)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=16)], 0) for i in range(60)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in
           flatgraph.near_vectors(spark.createDataFrame(rows, VECTORS), shard_rows=30, max_cells=3).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 3.0], 0), (5, [1.0, float("nan"), 3.0], 0),
            (6, [1.0, float("inf"), 3.0], 0), (7, [1.0, 2.0], 0), (8, v, None), (9, v, 0), (9, v, 0), (None, v, 0), (10, [-1.0, -2.0, -3.0], 0),
            (11, [2.0, 4.0, 6.0], 0), (12, [1e-30, 2e-30, 3e-30], 0), (13, [3e38, 1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("id", F.lit(1)).withColumn("x", F.lit(1)).withColumn("cell", F.lit(0))
    out = flatgraph.near_vectors(df).collect()
    assert len(out) == len(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}
    for i in (1, 2, 3, 4, 5, 6, 7, 10, 13):
        assert got[i] == (0, i, True)
    assert got[8] == (4, 8, True) and got[9] == (4, 8, False) and got[11] == (4, 8, False) and got[12] == (4, 8, False)
    assert got[None] == (0, None, True)
    assert flatgraph.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_every_length_link_with_their_own(spark):
    rows = []
    for dim, n, base in ((12, 150, 0), (5, 90, 1000), (3, 4, 2000), (1, 3, 3000)):
        rows += [(base + i, v[:dim] if len(v) >= dim else v + [0.0] * (dim - len(v)), 0) for i, v, _ in clouds(dim, n)[:n]]
    want = {}
    for dim in (12, 5, 3, 1):
        want |= brute([r for r in rows if len(r[1]) == dim])
    df = spark.createDataFrame(rows, VECTORS)
    out = flatgraph.near_vectors(df, shard_rows=100)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == want
    assert flatgraph.recall(df, out) == 1.0


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def test_base_scores_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randrange(0, 40), 12).title() + rng.choice(["", " ÉTÉ\x85x\xa0y", "\n\tZ.", "\x0b\x0c"])) for i in range(300)] + odd_rows()
    rows = [r for r in rows if r[0] is not None and r[0] != 7] + [(7, "one two"), (None, "One TWO")]
    out = pitmanyor.lm_scores(docs(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(t for i, x in rows if not held[i] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, x in rows:
        ts = tokens(x)
        want[i].append((held[i], len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    for r in out:
        near = [w for w in want[r["doc_id"]] if w[:4] == (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"])
                and abs(w[4] - r["base_score"]) < 1e-6 * max(1, abs(w[4]))]
        assert near, r
        assert r["score"] < 0
    spaces = pitmanyor.lm_scores(spark.createDataFrame([], DOCS))
    assert spaces.count() == 0


def test_model_beats_the_base_on_held_out_texts(spark):
    rng = random.Random(12)
    follow = {w: [f"{a}{w}" for a in "abcde"] for w in ("ing", "er", "ly", "st")}
    vocab = [w for ws in follow.values() for w in ws]

    def text():
        w, out = rng.choice(vocab), []
        for _ in range(80):
            out.append(w)
            w = rng.choice(follow[{"ng": "er", "er": "ly", "ly": "st", "st": "ing"}[w[-2:]]]) if rng.random() < 0.9 else f"rare{rng.randrange(500)}st"
        return " ".join(out)

    out = pitmanyor.lm_scores(docs(spark, [(i, text()) for i in range(300)])).filter("held_out").agg(
        F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert out[0] > out[1] + 0.2 * out[2]


def test_no_training_text(spark):
    rows = docs(spark, [(i, "a b") for i in range(5)])
    for r in pitmanyor.lm_scores(rows, held_out=F.lit(True)).collect():
        assert r["train_tokens"] == r["n_known"] == 0 and r["base_score"] == 0.0 and abs(r["score"]) < 1e-6


def test_chances_sum_to_one():
    """Over all words and one unknown, in the root, and in a context that every word was seen in."""
    texts = [b"ab cd", b"cd ab ab", b"ef"] * 5
    keys, _ = pitmanyor.token_keys(texts)
    x = pitmanyor.Shard(0, keys, np.ones(len(keys)))
    rows = []
    t2 = (x.c2 > 0).astype(float)
    for level, u, c, t in ((2, x.u2, x.c2, t2), (1, x.u1, x.up(t2), (x.up(t2) > 0) * 1.0), (0, np.zeros(x.n[2], int), x.root(x.up(t2) > 0), np.ones(x.n[2]))):
        for k in np.unique(u):
            m = u == k
            rows.append({"level": level, "u": int(k), "c": c[m].sum(), "t": t[m].sum(), "d": m.sum(), "ones": (c[m] == 1).sum(), "twos": (c[m] == 2).sum()})
    total = pitmanyor.Totals(rows)
    p0, p1, p2 = x.chances(t2, (x.up(t2) > 0) * 1.0, np.ones(x.n[2]), total)
    d, s = total.discount, pitmanyor.STRENGTH
    unknown = (s + d[0] * total.t0) * total.base / (s + total.c0)
    assert abs(p0.sum() + unknown - 1) < 1e-9
    assert (p1 > 0).all() and (p2 > 0).all() and (p2 < 1).all()


def test_keys_survive_packing():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (pitmanyor.unpack_keys(pitmanyor.pack_keys(keys)) == keys).all()
        some = rng.random(n).astype("<f4")
        assert (pitmanyor.unplanes(pitmanyor.planes(some), "<f4") == some).all()


def test_seating_agrees_with_one_by_one():
    rng = np.random.default_rng(0)
    for c, a, d in ((50, 2.0, 0.5), (700, 5.0, 0.3)):
        fast = pitmanyor.seat(np.random.default_rng(1), np.full(3000, float(c)), np.full(3000, a), d).mean()
        slow = []
        for _ in range(300):
            t = 1
            for i in range(1, c):
                t += rng.random() < a / (a + i - d * t)
            slow.append(t)
        assert abs(fast - np.mean(slow)) < 0.06 * np.mean(slow)
    assert pitmanyor.seat(rng, np.array([0.0, 1.0]), np.ones(2), 0.5).tolist() == [0, 1]


def places(cols, counts):
    length, rank, seq, offset, n = cols
    bins = defaultdict(list)
    runs = sorted(zip(length.tolist(), rank.tolist(), seq.tolist(), offset.tolist()))
    for i, (k, r, q, o) in enumerate(runs):
        stop = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == k else counts[k] + 1
        for x in range(stop - r):
            bins[q + x].append((o, k))
    return bins, n


@pytest.mark.parametrize("capacity", [5, 30, 100])
def test_plans_fill_without_gaps(capacity):
    rng = random.Random(capacity)
    for _ in range(100):
        counts = {k: rng.randrange(0, 9) for k in range(1, capacity + 1) if rng.random() < 0.5}
        bins, n = places(packing.plan(counts, capacity), counts)
        assert len(bins) == n and Counter(k for b in bins.values() for _, k in b) == +Counter(counts)
        for b in bins.values():
            end = 0
            for o, k in sorted(b):
                assert o == end
                end += k
            assert end <= capacity
            assert sum(3 * k > capacity for _, k in b) <= 2
        # Not worse than first fit, longest first.
        gaps = []
        for k in sorted((k for k, c in counts.items() for _ in range(c)), reverse=True):
            i = next((i for i, g in enumerate(gaps) if g >= k), None)
            if i is None:
                gaps.append(capacity - k)
            else:
                gaps[i] -= k
        assert n <= len(gaps) + 1


def test_packing_of_odd_rows(spark):
    rows = odd_rows()
    got = packing.packed(docs(spark, rows, extra=True), capacity=64).collect()
    enc = packing._encoder(packing.TOKENIZER)
    want = Counter()
    for i, t in rows:
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, k in enumerate(range(0, len(ids), 64)):
            want[(i, p, k, len(ids[k:k + 64]), zlib.crc32(ids[k:k + 64].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for o, k in sorted(b):
            assert o == end
            end += k
        assert end <= 64
    assert packing.packed(spark.createDataFrame([], DOCS)).count() == 0


def test_words_equal_the_whole_text():
    rng = random.Random(7)
    w = packing.Words(packing.TOKENIZER)
    letters = [chr(i) for i in range(9, 0x180)] + ["'s", "'ll", " ", " ", "́", "<|endoftext|>", "Σ", "日"]
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(25))
        assert w.encode(t) == w.plain(t)
