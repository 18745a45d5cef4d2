"""Cases of the third round's findings."""
import random
from difflib import SequenceMatcher

import numpy as np

from harrow.llm import htmltext, linededup
from harrow.operators import dedupe

PAGES = "page_id long, url string, html string"


def test_order_of_letters_bounds_the_ratio():
    """keys of the same letters in another order are told apart before any ratio is computed."""
    a, b = "abcdefghij klmnopqrst", "klmnopqrst abcdefghij"
    assert not dedupe.may_be_similar([a], [b], 0.88).any()
    rng = random.Random(5)
    keys = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 75))) for _ in range(80)]
    leaders = [k[:-2] + rng.choice(["", "a", "cab"]) for k in keys]
    fits = dedupe.may_be_similar(keys, leaders, 0.88)
    for i, k in enumerate(keys):
        for j, m in enumerate(leaders):
            assert fits[i, j] or SequenceMatcher(None, k, m).ratio() < 0.88


def test_common_length_equals_the_table():
    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for n, y in enumerate(b):
                before, row[n + 1] = row[n + 1], before + 1 if x == y else max(row[n + 1], row[n])
        return row[-1]

    rng = random.Random(6)
    keys = ["".join(rng.choice("abc d") for _ in range(rng.randrange(0, 65))) for _ in range(30)] + ["x" * 64, "x" * 65]
    leaders = ["".join(rng.choice("abce ") for _ in range(rng.randrange(0, 90))) for _ in range(30)] + ["x" * 70, ""]
    i, j = map(np.ravel, np.indices((len(keys), len(leaders))))
    got = dedupe.common_length(keys, leaders, i, j)
    assert got.tolist() == [brute(keys[x], leaders[y]) if len(keys[x]) <= 64 else -1 for x, y in zip(i, j)]


def test_pairs_of_tiles_are_spread_over_tasks(spark):
    """a block's tiles are small in bytes, but their comparisons are not put in one task."""
    keys = spark.range(4000).selectExpr("'h' as bnet", "'/p' as bpath", "sha2(cast(id as string), 256) as key", "id as rep")
    assert dedupe.similar_pairs(keys, keys, 0.88, True).rdd.getNumPartitions() > 1


def test_recurring_containers_inside_articles_go(spark):
    """subtree counts decide inside articles too, without a listed class or links."""
    note = "<div class=x1><p>Read us daily</p></div>"
    quote = "<blockquote><div>To be</div></blockquote>"
    body = "<div class=text>" + "<p>the same long body of a copied page</p>" * 3 + "</div>"
    rows = [(i, f"http://h/{i}", f"<body><article><p>own words number {i}, many of them</p><p>Licensed under CC.</p>{quote}{note}</article></body>") for i in range(30)]
    rows += [(100 + i, f"http://c/{i}", f"<article><p>copy</p><section>one part</section>{body}</article>") for i in range(30)]
    rows += [(200 + i, f"http://d/{i}", f"<article><p>at {i}</p>{body}</article>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    same = "\n".join(["the same long body of a copied page"] * 3)
    assert all(got[i] == f"own words number {i}, many of them\nLicensed under CC.\nTo be" for i in range(30))
    assert all(got[100 + i] == f"copy\none part\n{same}" for i in range(30))
    assert all(got[200 + i] == f"at {i}\n{same}" for i in range(30))


def test_words_hash_alike_at_every_place():
    """op2: hashes come from tables of powers, kept for a batch and made for longer texts, and don't depend on the place."""
    far = "x " * (linededup.SUB_BATCH // 2 + 100)
    lines = linededup.Lines([far + "some word", "  word", "", "word some"])
    assert lines.word[-4] == lines.word[-3] == lines.word[-2] and lines.word[-5] == lines.word[-1] != lines.word[-2]
    base = int(linededup._P)
    plain = sum((ord(c) + 7) * pow(base, k, 1 << 64) for k, c in enumerate("word")) % (1 << 64)
    assert lines.word[-2] == linededup.mix64(np.array([plain], np.uint64))[0]
    power, back = linededup.power_table(10)
    assert len(power) >= linededup.SUB_BATCH and (power * back == 1).all()
