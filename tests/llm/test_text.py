import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow.llm import decontaminate, tokencount, toxicity
from harrow.llm.tokencount import SPACE

from .util import DOCS, docs, odd_rows, words

LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(rng, 60, 30).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(60)] = "grumf" + rng.choice(["a", "or", "ist", "ly", "xo", "en"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, LABELS), dict((i, b) for i, _, b in labels)


def test_toxicity_learns_words_and_beginnings(spark):
    d, labels, truth = labelled(spark)
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    import zlib
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in truth)
    held = [i for i in truth if got[i]["held_out"]]
    right = sum(got[i]["predicted"] == truth[i] for i in held) / len(held)
    assert right > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    kept = {r["doc_id"] for r in toxicity.reject_toxic(d, labels).collect()}
    assert kept == {i for i in truth if not got[i]["predicted"]}


def test_labels_of_the_held_out_third_change_nothing(spark):
    d, labels, _ = labelled(spark, 300)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(d, labels).collect())
    b = sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(d, flipped).collect())
    assert a == b


def test_clauses_are_weighed_by_the_grammar():
    g = toxicity.SEED
    plain, addressed = g.clause(["the", "idiot"]), g.clause(["you", "idiot"])
    negated, reported = g.clause(["not", "an", "idiot"]), g.clause(["he", "said", "idiot"])
    assert addressed > plain > negated > 0 and plain > reported
    assert g.clause(["kill", "you"]) > 0 == g.clause(["kill", "time"]) == g.clause(["you", "kill"])
    # Clauses end negation and address.
    assert g.evidence("not. an idiot") == g.evidence("an idiot")
    assert g.score("") == g.score("nothing here") < 0.2


def test_the_composed_transducer_is_all_machines_in_step():
    rng = random.Random(2)
    some = ["kill", "you", "not", "said", "idiot", "moron", "x", "y", "hurt", "they"]
    g = toxicity.SEED
    for _ in range(500):
        tokens = [rng.choice(some) for _ in range(rng.randrange(14))]
        armed = negation = 0
        addressed = reported = False
        plain = total = 0.0
        for t in tokens:
            factor = (g.negated if negation else 1) * (g.reported if reported else 1)
            plain += 2.0 * factor * (t in ("idiot", "moron"))
            if t in ("you", "they"):
                addressed, total, armed = True, total + g.threat * factor * (armed > 0), 0
            armed, negation = max(0, armed - 1), max(0, negation - 1)
            armed = 3 if t in ("kill", "hurt") else armed
            negation = 3 if t == "not" else negation
            reported |= t == "said"
        assert abs(g.clause(tokens) - (total + plain * (g.addressed if addressed else 1))) < 1e-9, tokens
    assert len(toxicity.STATES) == len(set(toxicity.STATES)) == len(toxicity.ARCS)


def test_arc_weights_follow_the_rows():
    import numpy as np
    g = toxicity.SEED
    texts = [("you idiot", 1.0), ("not an idiot", 0.0), ("he said idiot", 1.0), ("fine", 0.0)]
    u = np.array([[0.0] * toxicity.USES if g.uses(t) is None else g.uses(t) for t, _ in texts])
    got = toxicity.fitted(g, u, np.array([y for _, y in texts]), np.full(4, 50.0))
    # Negated insults stand in clean rows only, reported ones in toxic rows; no row says anything of threats.
    assert got.negated < 0.95 * g.negated and got.reported > 1.1 * g.reported and got.threat == pytest.approx(g.threat)
    assert got.score("he said idiot") > 0.5 > got.score("not an idiot")


def test_toxicity_of_odd_rows(spark):
    rows = odd_rows()
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (7, 0, 0), (7, 0, 1)], LABELS).withColumn("text", F.lit("x"))
    d = docs(spark, rows, extra=True)
    out = toxicity.toxicity(d, labels).collect()
    assert len(out) == len(rows) and all(r["score"] is not None for r in out)
    assert toxicity.reject_toxic(d, labels).columns == d.columns
    none = spark.createDataFrame([], LABELS)
    assert toxicity.toxicity(d, none).count() == len(rows)
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def edits(rng, text, k):
    t = list(text)
    for _ in range(k):
        p, r = rng.randrange(len(t)), rng.random()
        if r < 0.34:
            t[p] = "q"
        elif r < 0.67:
            del t[p]
        else:
            t.insert(p, "z")
    return "".join(t)


def distance(item, text):
    """Least edits of ``item`` against any part of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, words(rng, rng.randrange(10, 30), 40)) for i in range(12)] + [(12, "abc"), (13, ""), (14, None), (15, "Tiny Item text")]
    rows = []
    for i in range(60):
        t = words(rng, 20, 40)
        if i % 3 == 0:
            j = rng.randrange(12)
            x = items[j][1]
            t += "  \n" + edits(rng, x, rng.randrange(0, int(0.12 * len(x)))).upper() + " " + words(rng, 5, 40)
        if i % 7 == 0:
            t += " an ABC here"
        rows.append((i, t))
    index = decontaminate.Index.build([(i, decontaminate.normal(t or "")) for i, t in items], 8, 0.08, 4)
    budget = dict(zip(index.ids, index.budget.tolist()))
    got = {r["doc_id"]: r for r in decontaminate.leak_report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in rows:
        n = decontaminate.normal(t)
        want = sorted(k for k, x in items if x and (x in n if len(x) < 8 else distance(decontaminate.normal(x), n) <= budget[k]))
        assert got[i]["item_ids"] == want and got[i]["contaminated"] == bool(want), i


def test_leaks_of_blocks_and_odd_rows(spark):
    rows = odd_rows() + [(20, "xx the quick brown fox jumps over the lazy dog yy")]
    bench = spark.createDataFrame([(1, "The quick brown\nfox jumps"), (1, "over the lazy dog"), (None, "one two"), (3, None), (4, "")],
                                  "item_id long, text string").withColumn("doc_id", F.lit(1))
    d = docs(spark, rows, extra=True)
    out = {r["doc_id"]: r["item_ids"] for r in decontaminate.leak_report(d, bench, block_chars=10).collect()}
    assert out[20] == [1] and all(v == [] for k, v in out.items() if k != 20)
    kept = decontaminate.drop_leaks(d, bench)
    assert kept.columns == d.columns and kept.count() == len(rows) - 1
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_leaks(d, empty).count() == len(rows)
    assert decontaminate.leak_report(spark.createDataFrame([], DOCS), bench).count() == 0


def unigram(pieces):
    from tokenizers import Tokenizer, models
    vocab = [("<unk>", 0.0)] + [(p, float(s)) for p, s in pieces] + [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    return Tokenizer(models.Unigram(vocab, 0, byte_fallback=True))


def test_counts_equal_the_unigram_tokenizer():
    rng = random.Random(9)
    pieces = tuple({"".join(rng.choice("ab" + SPACE) for _ in range(1)): -5, "a": -3, "aa": -5, "ab": -6, "ba": -6, "aab": -9, "bb": -8,
                    SPACE: -2, SPACE + "a": -4, SPACE + SPACE: -4, "b": -3}.items())
    v, t = tokencount.Viterbi(pieces), unigram(pieces)
    for _ in range(3000):
        s = "".join(rng.choice("aab  b") for _ in range(rng.randrange(1, 14)))
        assert v.count(s)[1] == len(t.encode(SPACE + s.replace(" ", SPACE)).ids), s


def test_counts_over_the_public_vocabulary():
    rng = random.Random(10)
    v = tokencount.Viterbi(tokencount.vocabulary())
    t = unigram(tokencount.vocabulary())
    known = {p for p, _ in tokencount.vocabulary()}
    for _ in range(300):
        s = " ".join(rng.choice(["the", "Worth", "éèa", "  ", "don't", "xyzzy", "über", "12", "日本", "a"]) for _ in range(12))
        assert v.count(s)[1] == len(t.encode(SPACE + s.replace(" ", SPACE)).ids)
    assert "\n" not in known
    assert v.count("a\nb")[1] == v.count("a")[1] + 1 + v.segment("b")[1]
    assert v.count("") == (0, 0)


def test_token_counts_of_odd_rows(spark):
    rows = odd_rows()
    out = tokencount.token_counts(docs(spark, rows, extra=True)).collect()
    assert len(out) == len(rows)
    by = Counter()
    for r in out:
        by[r["doc_id"]] += r["n_tokens"]
    assert by[1] == by[2] == 0 and by[5] == by[6] > 30_000 and by[9] > 0
    assert tokencount.token_counts(spark.createDataFrame([], DOCS)).count() == 0
