"""F6 of the third round: a context of the language model is the whole word before."""
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from harrow.llm import pitmanyor as py


def test_words_with_the_same_ending_are_contexts_of_their_own():
    keys, sizes = py.token_keys([b"xxly dog yyly cat", b"xxly dog"])
    word, before = keys[:, 0].tolist(), keys[:, 1].tolist()
    assert sizes.tolist() == [5, 3]
    assert before == [0, *word[:4], 0, *word[5:7]]
    assert before[1] != before[3] and before[1] == before[6]
    assert py.class_of(keys[[1, 3], 1]).tolist() == py.class_of(keys[[0, 2], 0]).tolist()


def test_the_word_before_predicts_the_next(spark):
    rng = random.Random(8)
    heads = [f"{a}{b}ly" for a in "abcdefghij" for b in "klmno"]
    follow = {w: f"n{i}" for i, w in enumerate(heads)}
    rows = [(i, " ".join(f"{w} {follow[w]}" for w in rng.choices(heads, k=40))) for i in range(200)]
    out = py.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    # Heads are drawn from 50, what follows is certain; by endings alone both would cost log10(50) = 1.7.
    assert out[0] / out[1] > -1.1


def _texts():
    """Texts, their keys, and which tokens are held out."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) if x < 400).encode() for _ in range(120)]
    keys, sizes = py.token_keys(texts)
    text = pd.DataFrame({"doc_id": np.arange(len(texts)), "text": [t.decode() for t in texts], "held_out": [i % 5 == 1 for i in range(len(texts))]})
    return text, keys, np.repeat(text["held_out"].to_numpy(), sizes)


def test_totals_over_shards_equal_those_of_one(monkeypatch, spark):
    """Customers of every restaurant and tables of every context, whichever way they go."""
    monkeypatch.setattr(py, "HOT", 3)
    monkeypatch.setattr(py, "FREQUENT", 10)
    monkeypatch.setattr(py, "CHUNK_TOKENS", 900)
    monkeypatch.setattr(py.Sums, "PARTS", {**py.Sums.PARTS, "often_c": 10, "often_t": 10, "hot_c": 3, "hot_n": 3})
    monkeypatch.setattr(py.Sums, "SIZE", sum(py.Sums.PARTS.values()))
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 1))
    text, keys, held = _texts()
    top = Counter(keys[:, 0].tolist()).most_common(10)
    known = SimpleNamespace(value=py.Frequent(np.array([w for w, _ in top], np.uint64)))
    by_shard = defaultdict(list)
    for out in py._chunks(8, known)([text]):
        for r in out[out["shard"] >= 0].to_dict("records"):
            by_shard[r["shard"]].append(r)
    assert len(by_shard) == 8
    train = keys[~held]
    want = Counter(train[:, 1].tolist())
    history, replies = [], defaultdict(list)
    for sweep in range(3):
        sums, asks, states = py.Sums(), defaultdict(list), []
        for shard, x in by_shard.items():
            batch = pd.DataFrame({"shard": [shard], "x": [x], "replies": [list(replies[shard])]})
            for out in py._sweep(known, SimpleNamespace(value=list(history)), 3)([batch]):
                for r in out.to_dict("records"):
                    if r["kind"] == 0:
                        asks[r["at"]].append(r)
                    else:
                        part = py.spread(r["t"], "<i8")
                        sums.vector[r["at"] * py.SLICE:r["at"] * py.SLICE + len(part)] += part
            _, _, s, got = next(py._each([batch], known.value))
            got = py._no_replies(sweep, got)
            states.append((s, s.state(history, got)))
        for out in py._reply(sweep)([pd.DataFrame([(k, v) for k, v in asks.items()], columns=["at", "asks"])]):
            for r in out.to_dict("records"):
                replies[r["shard"]].append(r)
        history.append(py.Totals.of(sums, history))
        tables = Counter()
        for s, (t2, _, _) in states:
            for u, t in zip(s.us.tolist(), s.by_context(t2).tolist()):
                tables[u] += t
        assert history[-1].tokens == len(train) and history[-1].words == len(set(train[:, 0].tolist()))
        assert history[-1].c0 == sum(t1.sum() for _, (_, t1, _) in states) and history[-1].c1.sum() == sum(tables.values())
        for s, (t2, _, _) in states:
            batch = pd.DataFrame({"shard": [s.number], "x": [by_shard[s.number]], "replies": [list(replies[s.number])]})
            got = py._no_replies(sweep + 1, next(py._each([batch], known.value))[3])
            total = s.seen(history, sweep, t2, got)
            assert total.c2.tolist() == [want[u] for u in s.us.tolist()]
            assert total.t2.tolist() == [tables[u] for u in s.us.tolist()]
        counts = Counter(train[:, 0].tolist())
        trained = set(py.hash_of(train[:, 0]).tolist())
        assert history[-1].hot_n.tolist() == [counts[w] for w, _ in top[:3]]
    # In a context that lies in several shards the chances of all words and of one unknown add up to one.
    last, whole = history[-1], {}
    u = known.value.words[0]
    p = mass = 0.0
    for s, (t2, t1, t0) in states:
        batch = pd.DataFrame({"shard": [s.number], "x": [by_shard[s.number]], "replies": [list(replies[s.number])]})
        total = s.seen(history, 2, t2, py._no_replies(3, next(py._each([batch], known.value))[3]))
        p0, p1, p2 = s.chances(t2, t1, t0, total)
        here = s.us[s.u2] == u
        p += p2[here].sum()
        mass += p1[s.to1][here].sum()
        for w, x in zip(s.words.tolist(), p0.tolist()):
            assert abs(whole.setdefault(w, x) - x) < 1e-12
    at = known.value.code(py.hash_of(np.array([u])))[0]
    c, t = last.often_c[at], last.often_t[at]
    back = (py.STRENGTH + last.discount[2] * t) / (py.STRENGTH + c)
    assert abs(sum(x for w, x in whole.items() if w in trained) + last.pull0() / (py.STRENGTH + last.c0) - 1) < 1e-9
    assert abs(p + back * (1 - mass) - 1) < 1e-9
