import random
import re
from collections import Counter

import pytest

from harrow.llm import stripes

from .util import DOCS, docs, odd_rows


def brute(rows, top=2000, least=10, share=50):
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                counts.setdefault(lang, Counter()).update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rest = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            if len(p) == 2 and any(b >= least and len(q) == 3 and p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in f.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rest.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(rest)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    fixed = [" ".join(f"{c}{i}" for i in range(m)) for c, m in zip("pqrst", (2, 3, 4, 5, 3))]
    rows = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(12)):
            r = rng.random()
            parts.append(rng.choice(fixed) if r < 0.3 else rng.choice(["Hot", "hot", "É", "é", "x\x00y", " ", "a-b", "z" * 300]) if r < 0.6
                         else f"w{int(rng.paretovariate(0.7)) % 500}")
            parts.append(rng.choice([" ", "  ", "\t", ". ", ",", "\n", "\r\n", ";", " : ", "!?"]) if rng.random() < 0.5 else " ")
        rows.append((rng.choice(["en", "en", "en", "de", None, "", "und"]), "".join(parts)))
    return rows


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, lang, "s", None) for i, (lang, t) in enumerate(rows)], DOCS)
    return sorted(map(tuple, stripes.collocations(df.repartition(6), **kw).collect()))


def test_phrases_equal_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert want and found(spark, rows) == want
    assert found(spark, rows, top=3, least=4, share=80) == brute(rows, 3, 4, 80)


def test_slices_of_hot_prefixes_and_many_flushes(spark):
    # Sixty parts: several prefixes of this corpus are hot, and every few texts make stripes of their own.
    rows = corpus(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(spark, rows, slices=60, flush=2000) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("least", [1, 10])
def test_odd_rows(spark, least):
    rows = odd_rows()
    got = sorted(map(tuple, stripes.collocations(docs(spark, rows, extra=True), least=least, top=50).collect()))
    small = [("en", t) for _, t in rows]
    if least == 10:
        assert got == brute(small, 50, least)
    else:
        assert len(got) == 50 and got[0][1:2] == (1,)
    assert stripes.collocations(docs(spark, []).filter("false")).count() == 0


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(4_000_000_000_000, 5_000_000_000_000, 4_100_000_000_001)], "a long, l long, r long")
    a, l, r = 4_000_000_000_000, 5_000_000_000_000, 4_100_000_000_001
    assert df.select(stripes._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * a * a // (l * r)
