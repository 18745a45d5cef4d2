import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import piecetable

from .util import docs, odd_rows


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piecetable.MODEL))


def ids(b):
    return np.frombuffer(b, "<u4").tolist()


def check(model, text):
    p = piecetable.pieces(piecetable.MODEL)
    want = model.encode(text, add_bos=True, add_eos=True)
    assert ids(p.encode(text)) == want, repr(text)
    assert p.decode(p.encode(text)) == model.decode(want), repr(text)


def test_random_texts(model):
    rng = random.Random(11)
    some = ["a", "the", " ", "   ", "\n", "\t", ".", ",”", "é", "ß", "1", "_", "(", "//", "==", "...", "😀", "中", "の", "　", "▁", "\x00",
            "İ", "क", "्", "»", "…", "²", "́", "​", "�"]
    vocabulary = list(piecetable.pieces(piecetable.MODEL).id)
    for _ in range(6000):
        check(model, "".join(rng.choice(some if rng.random() < 0.5 else vocabulary) for _ in range(rng.randrange(12))))


def test_runs_of_spaces_and_equal_scores(model):
    rng = random.Random(12)
    for _ in range(3000):
        check(model, "".join(rng.choice(" ▁a=-*#_\n") for _ in range(rng.randrange(70))))
    for n in range(80):
        check(model, " " * n)
        check(model, "x" + " " * n + "y")
    check(model, "ab" * 40_000)
    check(model, "z" * 50_000)


def test_decoding_of_any_ids(model):
    rng = random.Random(13)
    p = piecetable.pieces(piecetable.MODEL)
    for _ in range(5000):
        row = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(32_000), 259, 28705]) for _ in range(rng.randrange(8))]
        assert p.decode(np.array(row, "<u4").tobytes()) == model.decode(row), row


def test_last_tokens_are_those_of_every_prefix(model):
    p = piecetable.pieces(piecetable.MODEL)
    s = "▁unbelievably▁▁interesting▁thththth"
    last = p.table(s)
    for n in range(1, len(s) + 1):
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        assert out[::-1] == model.encode(s[1:n], out_type=str) or n == 1


def test_whole_table(spark, model):
    rows = odd_rows() + [(20, "Hello wörld.\n\nNext  line 42"), (21, "x" * 9 + " " * 9)]
    got = piecetable.digests(docs(spark, rows, extra=True))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for i, t in rows:
        e = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(model.decode(e).encode("utf-8", "surrogatepass")).hexdigest()))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert piecetable.digests(docs(spark, []).filter("false")).count() == 0


def test_own_columns(spark, model):
    df = docs(spark, [(1, "one two"), (2, None)]).withColumn("ids", F.lit(1))
    out = {r["doc_id"]: r for r in piecetable.with_pieces(df, ids="tokens", text="back").collect()}
    assert ids(out[1]["tokens"]) == model.encode("one two", add_bos=True, add_eos=True) and out[1]["back"] == "one two" and out[1]["ids"] == 1
    assert ids(out[2]["tokens"]) == [1, 2] and out[2]["back"] == "" and out[2]["text"] is None
