"""Cheaper forms of the parse and the label rules give what the plain ones give."""
from pyspark.sql import functions as F

from harrow.functions import text as T
from harrow.functions.urls import parts, resolve, resolve_split
from harrow.operators.extract import FOLDED, first_letter, folded, whole_word


def test_white_space_by_its_property_is_the_listed_one(spark):
    chars = spark.range(1, 0x11000).filter("id < 55296 or id > 57343") \
        .select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert chars.filter(F.col("c").rlike(T.JAVA_WS) != F.col("c").rlike(T.WS)).isEmpty()


def test_first_letters():
    words = {"english": "e", "Que": "Q", r"[ab]c": "", r"\bno": "", "a|b": "", "x?y": "", "élan": "", "": "", "(": "", "9a": "", "sk.*": "s"}
    assert {w: first_letter(w) for w in words} == words


def test_words_are_found_in_every_case_and_nowhere_else(spark):
    words = ["sk", "kit", "it"]
    texts = ["a SK b", "a ſK b", "KIT.", "kits", "xsk", "", "it", "İt", "ıT x", "_it", "sk9", "so kite sk"]
    t = F.col("t")
    plain = t.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:sk|kit|it)(?![\p{L}\p{N}_])")
    rows = spark.createDataFrame([(x,) for x in texts], "t string") \
        .select(t, plain.alias("a"), whole_word(t, words).alias("b"), folded(t).alias("f"), F.lower(F.translate(t, *FOLDED)).alias("g")).collect()
    assert all(r["a"] == r["b"] and r["f"] == r["g"] for r in rows) and {r["a"] for r in rows} == {True, False}


def test_a_page_is_split_once_for_all_its_links(spark):
    rows = spark.createDataFrame([("http://a.test/x/y;?q#f", h) for h in ("", "../z", "?p", "//b.test", "HTTP:w", "#t", "/r;", "mailto:x")], "b string, h string")
    b, h = F.col("b"), F.col("h")
    out = rows.select(resolve(b, h).alias("r"), F.element_at(T.let(parts(b), lambda p: F.transform(F.array(h), lambda x: resolve_split(b, p, x))), 1).alias("s"))
    assert all(r["r"] == r["s"] for r in out.collect())
