import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import linededup, minhash
from harrow.llm.common import components, member_test, mix64

from .util import DOCS, docs, odd_rows, words


def classes(pairs, ids):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_components_of_chains_hubs_and_loops(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(200, 200)]
    edges += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(80)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(edges, {i for e in edges for i in e})
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_member_test_never_misses(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("k"))
    among = member_test(keys, "k")
    assert spark.range(5000).filter(~among(F.xxhash64("id"))).count() == 0
    assert spark.range(10_000, 60_000).filter(among(F.xxhash64("id"))).count() < 50
    zero = member_test(spark.createDataFrame([(0,), (1 << 26,), (-1,)], "k long"), "k")
    got = spark.createDataFrame([(0,), (1,), (-1,), (2,)], "k long").filter(zero("k")).collect()
    assert sorted(r["k"] for r in got) == [-1, 0]


@pytest.mark.parametrize("k", [64, 120])
def test_dart_minhash_estimates_weighted_jaccard(k):
    rng = np.random.default_rng(3)
    ids = np.unique(mix64(rng.integers(0, 2**60, 300).astype(np.uint64)))
    errors = []
    for _ in range(40):
        wa, wb = rng.integers(0, 4, len(ids)), rng.integers(0, 4, len(ids))
        salt = np.uint64(rng.integers(0, 2**60))
        a = (mix64(ids[wa > 0] ^ salt), wa[wa > 0])
        b = (mix64(ids[wb > 0] ^ salt), wb[wb > 0])
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        errors.append((minhash.dart_minhash(*a, k) == minhash.dart_minhash(*b, k)).mean() - true)
    assert abs(np.mean(errors)) < 0.03


def test_dart_minhash_of_fractional_weights():
    ids = mix64(np.arange(200, dtype=np.uint64))
    wa, wb = np.full(200, 0.5), np.r_[np.full(100, 0.5), np.full(100, 0.25)]
    got = np.mean([(minhash.dart_minhash(mix64(ids + np.uint64(s * 1000)), wa, 128) == minhash.dart_minhash(mix64(ids + np.uint64(s * 1000)), wb, 128)).mean()
                   for s in range(20)])
    assert abs(got - 0.75) < 0.05


def test_overlaps_equal_pairwise_sums():
    rng = random.Random(2)
    texts = [words(rng, rng.randrange(1, 60), 6) for _ in range(20)]
    s = [minhash.shingles(t, 2) for t in texts]
    got = minhash.overlaps(s, columns=16)
    for i in range(20):
        for j in range(20):
            if i != j:
                want = minhash.similarity(s[i], s[j])
                assert abs(got[i, j] / (s[i][1].sum() + s[j][1].sum() - got[i, j]) - want) < 1e-6


def corpus(seed, n=60):
    rng = random.Random(seed)
    rows, base = [], [words(rng, rng.randrange(20, 120)).split() for _ in range(n)]
    for i, b in enumerate(base):
        rows.append((i, " ".join(b)))
    for i in range(n, 4 * n):
        b = list(rng.choice(base[: n // 3]))
        for _ in range(rng.randrange(0, 5)):
            b[rng.randrange(len(b))] = "edit%d" % rng.randrange(1000)
        rows.append((i, " ".join(b)))
    return rows


@pytest.mark.parametrize("block", [256, 7])
def test_near_duplicates_equal_brute_force(spark, block):
    rows = corpus(11)
    s = {i: minhash.shingles(t) for i, t in rows}
    pairs = [(a, b) for a in s for b in s if a < b and minhash.similarity(s[a], s[b]) >= 0.8]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), block=block).collect()}
    assert got == classes(pairs, s)


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(docs(spark, rows, extra=True)).collect())
    assert len(got) == len(rows)
    by = {i: c for i, c, _ in got if i}
    assert by[1] == by[2] == 1 and by[5] == by[6] == 5 and by[7] == 7 and by[9] == 9
    assert [k for i, _, k in got if not i] == [True, True]
    kept = minhash.drop_near_duplicates(docs(spark, rows, extra=True))
    assert kept.columns == docs(spark, rows, extra=True).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 7, 8, 9, 10]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    assert minhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def sentences(rng, n):
    return " ".join(words(rng, rng.randrange(5, 12)).capitalize() + "." for _ in range(n))


def test_lines_are_found_alike_in_any_place():
    a = linededup.Lines(["hello there. World peace"])
    b = linededup.Lines(["Xx yy hello there.\nWorld peace", "", "Hello there"])
    assert a.hash[1] == b.hash[list(b.start).index(19)]
    assert list(b.first) == [0, 2, 2, 3]


def test_passages_are_cut_from_later_documents(spark):
    rng = random.Random(4)
    passage = [sentences(rng, 12) for _ in range(6)]
    rows, clean = [], {}
    for i in range(80):
        before, after = sentences(rng, 6), sentences(rng, 6)
        if i % 4 == 0:
            rows.append((i, f"{before[:-1]} and {passage[i % 6]} tail{i} {after}"))
        else:
            rows.append((i, f"{before}\n{after}"))
            clean[i] = rows[-1][1]
    out = {r["doc_id"]: r for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert all(out[i]["text"] == t for i, t in clean.items())
    seen, left = set(), 0
    for i, t in rows:
        if i not in clean:
            p = passage[i % 6]
            if i % 6 not in seen:
                seen.add(i % 6)
                assert out[i]["text"] == t
            else:
                left += sum(s in out[i]["text"] for s in p.split(". "))
                assert out[i]["n_chars"] == len(out[i]["text"])
                assert f"tail{i} " in out[i]["text"]
    assert left <= 0.1 * 12 * (20 - len(seen))


def test_what_is_cut_occurs_earlier(spark):
    rng = random.Random(8)
    stock = [sentences(rng, 1) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(stock) for _ in range(rng.randrange(3, 40)))) for i in range(60)]
    text = dict(rows)
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, rows), min_words=10).collect()}
    assert any(out[i] != text[i] for i in text)
    for i in text:
        # Every line that went is kept in a document that is not later.
        gone = set(text[i].split("\n")) - set(out[i].split("\n"))
        assert all(any(g in out[j] for j in range(i + 1)) for g in gone)


@pytest.mark.parametrize("kind", ["lines", "flat"])
def test_every_pasted_passage_of_50_words_is_cut(spark, kind):
    rng = random.Random(21)
    flat = lambda n: words(rng, n, 40_000)
    some = lambda n: " ".join(w.capitalize() + rng.choice(["", "."]) if rng.random() < 0.1 else w for w in flat(n).split())
    text = flat if kind == "flat" else some
    passages = [text(rng.randrange(51, 81)) for _ in range(60)] + [text(900)]
    rows = [(100 * d + i, f"{text(40)} a{d}b{i} {p} c{d}d{i} {text(40)}") for d in range(2) for i, p in enumerate(passages)]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    for i, p in enumerate(passages):
        assert out[i] == rows[i][1]
        assert out[100 + i] == rows[len(passages) + i][1].replace(p + " ", "")


def test_a_text_that_repeats_itself_keeps_its_beginning(spark):
    rng = random.Random(5)
    part = words(rng, 70)
    rows = [(1, " ".join(["tick"] * 300)), (2, " ".join([part] * 3) + " end"), (3, "A b. " * 100)]
    out = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs(spark, rows)).collect()}
    assert out[2] == part + " end" and set(out[1].split()) == {"tick"} and 25 <= len(out[1].split()) < 100
    assert out[3].startswith("A b. " * 5) and len(out[3]) < 250


def test_line_dedup_of_odd_rows(spark):
    rows = odd_rows()
    got = linededup.dedup_lines(docs(spark, rows, extra=True))
    assert got.columns == docs(spark, rows, extra=True).columns
    out = got.collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r["text"] for r in out}
    assert by[1] is None and by[2] == "" and by[3] == "  \n " and by[7] == "one two" and by[5] == dict(rows)[5]
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0
