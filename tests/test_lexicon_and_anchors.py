"""Large lexicons as tables, and rules that run only where their anchors stand."""
import random
import re

import pytest
from pyspark.sql import functions as F

from harrow import config as C
from harrow.config import DEFAULT, TEST
from harrow.operators.extract import JAVA_FLAGS, anchors, first_match, folded, whole_word
from harrow.operators.scoring import contained_terms, lexicon_table, score_by_table, score_columns, score_pages

PAGES = "page_id long, title string, url string, text string"


def pages(spark, seed, n=60):
    rng = random.Random(seed)
    bit = lambda: rng.choice(["of the", "At The", "with the", "der ", "THIS", "was", "blog", "x", "é", "İ", "\n", "a.b", " ", "ab", "abc", "abcd", "abcde"])
    rows = [(i, rng.choice([None, bit() + bit()]), f"https://h.test/{bit().strip()}/en/{i}", rng.choice([None, "", " ".join(bit() for _ in range(rng.randrange(40)))]))
            for i in range(n)]
    return spark.createDataFrame(rows, PAGES)


def scores(df):
    return sorted((r["page_id"], r["candidate_score"], tuple(r["matched_keywords"]), r["candidate_type"], r["reason"]) for r in df.collect())


@pytest.mark.parametrize("cfg", [TEST, TEST.with_(high_keywords=["", "a", "ab", "abc", "abcd", "abcde", "é", "a.b", "\n"], low_keywords=["ab", "ab", "zz"], url_hints=[],
                                                  action_terms=[], score_text_chars=30)], ids=["test", "odd"])
def test_a_table_gives_the_scores_of_the_expressions(spark, cfg):
    df = pages(spark, 1)
    want = scores(score_columns(df, cfg))
    assert len({s[1] for s in want}) > 3
    assert scores(score_by_table(df, lexicon_table(spark, cfg), "page_id", cfg)) == want
    assert score_by_table(df, lexicon_table(spark, cfg), "page_id", cfg).columns == score_columns(df, cfg).columns


def test_ten_thousand_terms(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij ") for _ in range(rng.randrange(1, 9)))
    cfg = DEFAULT.with_(high_keywords=[word() for _ in range(9000)], low_keywords=[word() for _ in range(800)], url_hints=[word().strip() or "h" for _ in range(100)],
                        action_terms=[word() for _ in range(100)])
    rows = [(i, None, f"https://h.test/{word().strip()}", " ".join(word() for _ in range(rng.randrange(30)))) for i in range(40)]
    df = spark.createDataFrame(rows, PAGES)
    out = score_pages(df, cfg, "page_id")
    got = {r["page_id"]: r for r in out.collect()}
    for i, _, url, text in rows:
        hay = f" {url} {text}".lower()
        high, low = ([t for t in terms if t in hay] for terms in (cfg.high_keywords, cfg.low_keywords))
        assert got[i]["matched_keywords"] == high + low
        base = min(100, 15 * len(high) + 5 * len(low) + 3 * sum(t in url.lower() for t in cfg.url_hints))
        assert got[i]["candidate_score"] == (min(100, base + 10) if any(t in hay for t in cfg.action_terms) else base)
    few = score_by_table(df, lexicon_table(spark, TEST), "page_id")
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    assert size(out) < 1.2 * size(few)


def test_terms_meet_beginnings_without_the_texts(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab\u00e9\U0001f600 ") for _ in range(n))
    texts = [(i, rng.choice([None, "", word(5000), word(40), word(300) + "x" * 90])) for i in range(50)]
    terms = [("high", i, t) for i, t in enumerate([word(n) for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 12) * 30] + ["", "x" * 64, "x" * 65, "x" * 91, texts[-1][1] or "a"])]
    df = spark.createDataFrame(texts, "id long, t string")
    found = contained_terms(df, "id", "t", spark.createDataFrame(terms, "kind string, pos int, term string"))
    assert {tuple(r) for r in found.collect()} == {(i, *x) for i, t in texts if t is not None for x in terms if x[2] in t}
    # A row for each gram of a text must not hold the text.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Generate explode\((?!filter\()", plan)


def test_every_match_holds_an_anchor(spark):
    assert anchors(r"Fees?[:\s]+(.+)") == ("fee",) and anchors(r"(?:Start|End) date[:\s]+(x)") == (" date",) and anchors(r"(a|b?)c*") == ()
    assert set(anchors(r"(?:Housing|Dormitory)[:\s]+(.*)")) == {"housing", "dormitory"} and anchors(r"(?<bad") == ()
    rng = random.Random(3)
    patterns = sorted({p for cfg in (DEFAULT, TEST) for ps in cfg.field_patterns.values() for p in ps})
    labels = [re.split(r"[\[(]", p.lstrip("(?:"))[0] for p in patterns]
    odd = str.maketrans({"s": "ſ", "i": "ı", "I": "İ", "k": "K", "K": "K"})
    texts = []
    for _ in range(400):
        parts = [rng.choice(labels) + rng.choice([": ", " ", ":"]) + rng.choice(["x", "some value of 5 EUR", "y" * 30]) for _ in range(rng.randrange(4))]
        text = rng.choice([". ", "\n", " "]).join(parts)
        texts.append(rng.choice([str, str.upper, str.lower, lambda t: t.translate(odd), lambda t: t.upper().translate(odd)])(text))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    t = F.col("t")
    plain = [F.regexp_extract(t, JAVA_FLAGS + p, 1).alias(f"p{k}") for k, p in enumerate(patterns)]
    guarded = [first_match(t, [p]).alias(f"g{k}") for k, p in enumerate(patterns)]
    hits = 0
    for r in df.select("i", *plain, *guarded).collect():
        for k in range(len(patterns)):
            assert (r[f"g{k}"] == "Unknown") == (not r[f"p{k}"]), (r["i"], patterns[k])
            hits += bool(r[f"p{k}"])
    assert hits > 300
    words = ["housing", "dormitory", "in"]
    free = F.coalesce(t.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"), F.lit(False))
    some = spark.createDataFrame([(x,) for x in ["Housing!", "no", "DORMİTORY", "dormıtory", "houſing", "inn", "a in b", None]], "t string")
    assert all(r["a"] == r["b"] for r in some.select(free.alias("a"), F.coalesce(whole_word(t, words, folded(t)), F.lit(False)).alias("b")).collect())


def test_texts_without_a_label_run_no_rule(spark):
    # An expression that would take for ever on this text isn't tried.
    rule = r"Label[:\s]+((?:a|a)*)b"
    df = spark.createDataFrame([("a" * 5000,), ("label: " + "a" * 5 + "b",)], "t string")
    assert [r[0] for r in df.select(first_match(F.col("t"), [rule])).collect()] == ["Unknown", "aaaaa"]
    assert C.FIELD_PATTERNS and all(anchors(p) for ps in C.FIELD_PATTERNS.values() for p in ps)
