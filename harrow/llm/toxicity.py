"""Toxicity scores from a weighted finite-state pattern grammar.

Four small transducers read the kinds of a clause's tokens (threat verb, target,
negation, verb of saying), each with states and arcs of its own:

* *threat*: a threat verb arms it for ``REACH`` tokens; a target on an armed state fires;
* *target*: goes to "addressed" at a target and stays;
* *negation*: open for ``REACH`` tokens after a negation word;
* *reported speech*: open from a verb of saying to the end of the clause.

They are composed once, into one transducer whose states are the reachable tuples
of theirs and whose arcs carry all outputs.  The fifth, *insult*, is composed with
it token by token: a token of the lexicon emits its weight.  An arc multiplies
what it emits by the weights of the machines that are open on it; "addressed" is a final
weight of the clause.  A document scores the sum over its clauses, and a
logistic curve turns that into 0..1.  Isolated words therefore count through the
clause that they stand in.

The arc weights (negated, reported, addressed, threat) are fitted on the training
rows together with the curve, towards start values that hold where the rows say nothing.
The lexicon is learnt: words and word beginnings whose document frequency in
toxic rows exceeds that in clean rows by a log-likelihood test.  It is fitted on
a bounded sample of labelled training rows (``max_train``, split evenly between
the classes, chosen by a hash of the id); scoring covers every row and its
whole text.

Defined cases: a null or empty text scores as a text without matches; a null
id counts as training side and has no label; labels with a null class are
ignored, and of several labels of one id the largest counts; repeated rows are
scored alike; without any usable label only the fixed words count.
"""
from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, staged, text_of

# Words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy attack shoot stab beat strangle töten umbringen schlagen tuer frapper matar golpear".split()
TARGETS = ("you your yours yourself u ur they them he she du dich dir dein ihr euch "
           "tu toi ton vous votre tú ti tus usted vosotros").split()
NEGATIONS = "not never no neither nor isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás ni".split()
REPORTS = "said says say wrote claimed quoted reported called sagte schrieb meinte dit écrit disait dijo escribió".split()
INSULTS = ("idiot moron clown worthless pathetic scum trash loser disgusting stupid "
           "dummkopf arschloch imbécile connard idiota imbécil").split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
ANY = re.compile(r"\w+")
CLAUSE = re.compile(r"[.,;:!?|\n\r\"()\[\]]+")
PREFIXES = (4, 5, 6)


REACH = 3
THREAT, TARGET, NEGATION, REPORT = 1, 2, 4, 8
KINDS: dict[str, int] = {}
for _words, _kind in ((THREATS, THREAT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT)):
    for _w in _words:
        KINDS[_w] = KINDS.get(_w, 0) | _kind


@dataclass(frozen=True)
class Transducer:
    """Arcs ``(state, kind) -> (state, output)`` over token kinds; the start is state 0."""

    arcs: dict[tuple[int, int], tuple[int, bool]]

    @classmethod
    def of(cls, states: int, step) -> Transducer:
        return cls({(q, k): step(q, k) for q in range(states) for k in range(16)})


# A machine's output tells whether it is open on the arc, or fires on it.
MACHINES = (
    Transducer.of(REACH + 1, lambda q, k: (REACH if k & NEGATION else max(0, q - 1), q > 0)),
    Transducer.of(2, lambda q, k: (1 if k & REPORT else q, q > 0)),
    Transducer.of(REACH + 1, lambda q, k: (REACH if k & THREAT else 0 if k & TARGET else max(0, q - 1), q > 0 and bool(k & TARGET))),
    Transducer.of(2, lambda q, k: (1 if k & TARGET else q, False)),
)


def compose(machines) -> tuple[list[tuple[int, ...]], list[list[tuple[int, tuple[bool, ...]]]]]:
    """One transducer that runs all of them: its states (tuples of theirs), and for each state and kind the next state and outputs."""
    states, number, arcs = [(0,) * len(machines)], {(0,) * len(machines): 0}, []
    for state in states:
        row = []
        for kind in range(16):
            steps = [m.arcs[q, kind] for m, q in zip(machines, state)]
            to = tuple(q for q, _ in steps)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append((number[to], tuple(out for _, out in steps)))
        arcs.append(row)
    return states, arcs


STATES, ARCS = compose(MACHINES)
#: Where a clause's emissions go: insults by (negated, reported, addressed), then fired threats by (negated, reported).
USES = 12


@dataclass(frozen=True)
class Grammar:
    """Lexicon, arc weights and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    addressed: float = 1.25
    negated: float = 0.4
    reported: float = 0.5
    threat: float = 3.0
    ceiling: float = 12.0
    intercept: float = -3.0
    slope: float = 1.5

    def insult(self, token: str) -> float:
        w = self.weights.get(token, 0.0)
        for n in PREFIXES:
            if len(token) > n:
                w = max(w, self.prefixes.get(token[:n], 0.0))
        return w

    def use_weights(self) -> np.ndarray:
        return _use_weights(self.negated, self.reported, self.addressed, self.threat)

    def clause_uses(self, tokens: list[str]) -> list[float]:
        """One run of the composed transducer over a clause: what each kind of arc emits, not yet weighted."""
        state, uses = 0, [0.0] * USES
        for t in tokens:
            state, (negated, reported, fired, _) = ARCS[state][KINDS.get(t, 0)]
            if fired:
                uses[8 + 2 * negated + reported] += 1.0
            if w := self.insult(t):
                uses[4 * negated + 2 * reported] += w
        if STATES[state][3]:
            uses[0:8:2], uses[1:8:2] = [0.0] * 4, uses[0:8:2]
        return uses

    def clause(self, tokens: list[str]) -> float:
        return float(self.use_weights() @ self.clause_uses(tokens))

    def uses(self, text: str) -> np.ndarray | None:
        """Emissions of a whole text; None if no word of it can emit."""
        low = text.lower()
        seen = set(WORD.findall(low))
        hit = not seen.isdisjoint(self.weights) or not seen.isdisjoint(_THREATS)
        for n in PREFIXES if not hit else ():
            if not {t[:n] for t in seen if len(t) > n}.isdisjoint(self.prefixes):
                hit = True
                break
        if not hit:
            return None
        return np.sum([self.clause_uses(WORD.findall(c)) for c in CLAUSE.split(low)], axis=0)

    def evidence(self, text: str) -> float:
        uses = self.uses(text)
        return 0.0 if uses is None else min(self.ceiling, float(self.use_weights() @ uses))

    def score(self, text: str) -> float:
        return 1.0 / (1.0 + math.exp(-(self.intercept + self.slope * self.evidence(text))))


def _use_weights(negated: float, reported: float, addressed: float, threat: float) -> np.ndarray:
    both = [n * r for n in (1.0, negated) for r in (1.0, reported)]
    return np.array([b * a for b in both for a in (1.0, addressed)] + [threat * b for b in both])


_THREATS = frozenset(THREATS)
SEED = Grammar(weights=dict.fromkeys(INSULTS, 2.0))


def train_rows(labels: DataFrame, max_train: int) -> DataFrame:
    """``(doc_id, toxic)`` of at most about ``max_train`` training rows, half of them toxic."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1)) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, max_train / 2 / v) for k, v in n.items()}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return own.filter(draw < F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))


def _families(batches):
    """Adds the smallest hash of a text's three-word shingles: near copies mostly share it.

    One row per value is learnt from, so that the words of one much-copied text
    don't look like the words of many texts.
    """
    for b in batches:
        keys = []
        for text in b["text"].tolist():
            w = ANY.findall(text.lower())
            keys.append(min((zlib.crc32(" ".join(w[i:i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0))
        yield b[["text", "toxic"]].assign(family=keys)


def _count(batches):
    toxic, clean = Counter(), Counter()
    rows = [0, 0]
    for b in batches:
        for text, y in zip(b["text"].tolist(), b["toxic"].tolist()):
            words = set(WORD.findall(text.lower()))
            feats = {"=" + w for w in words}
            for n in PREFIXES:
                feats.update("^" + w[:n] for w in words if len(w) > n)
            (toxic if y else clean).update(feats)
            rows[1 if y else 0] += 1
    toxic["#"], clean["#"] = rows[1], rows[0]
    keys = list(toxic.keys() | clean.keys())
    for i in range(0, len(keys), 50_000):
        k = keys[i:i + 50_000]
        yield pd.DataFrame({"feature": k, "t": [toxic.get(x, 0) for x in k], "c": [clean.get(x, 0) for x in k]})


def _entropy(k, n):
    return F.when(k > 0, k * F.log(k / n)).otherwise(F.lit(0.0))


def learn(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_lexicon: int = 5_000,
          min_docs: int = 4, min_llr: float = 20.0, min_weight: float = 3.0) -> Grammar:
    """Fit lexicon and curve on the labelled training rows (at most about ``max_train``)."""
    sample = train_rows(labels.select("doc_id", "toxic"), max_train)
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")
    rows = staged(rows.mapInPandas(_families, "text string, toxic int, family long")
                  .dropDuplicates(["toxic", "family"]).select("text", "toxic"), "sample")
    counts = staged(rows.mapInPandas(_count, "feature string, t long, c long") \
        .groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")) \
        .filter((F.col("feature") == "#") | (F.col("t") >= min_docs)), "features")
    total = counts.filter("feature = '#'").first()
    if total is None or not total["t"] or not total["c"]:
        return SEED
    t, c, T, C = F.col("t").cast("double"), F.col("c").cast("double"), F.lit(float(total["t"])), F.lit(float(total["c"]))
    llr = 2 * (_entropy(t, T) + _entropy(T - t, T) + _entropy(c, C) + _entropy(C - c, C)
               - _entropy(t + c, T + C) - _entropy(T + C - t - c, T + C))
    weight = F.log((t + 0.5) / (T + 1.0)) - F.log((c + 0.5) / (C + 1.0))
    found = counts.filter("feature <> '#'").select("feature", "t", llr.alias("llr"), weight.alias("w")) \
        .filter((F.col("llr") >= min_llr) & (F.col("w") >= min_weight)) \
        .orderBy(F.desc("llr"), "feature").limit(max_lexicon).collect()
    weights = dict(SEED.weights) | {r["feature"][1:]: min(6.0, r["w"]) for r in found if r["feature"][0] == "="}
    # A beginning stands on its own only if no single word makes up most of it.
    whole = Counter()
    for r in found:
        for n in PREFIXES if r["feature"][0] == "=" else ():
            whole[r["feature"][1:n + 1]] = max(whole[r["feature"][1:n + 1]], r["t"])
    prefixes = {r["feature"][1:]: min(6.0, r["w"]) for r in found
                if r["feature"][0] == "^" and whole[r["feature"][1:]] < 0.7 * r["t"]}
    grammar = Grammar(weights=weights, prefixes=prefixes)

    def uses(batches):
        for b in batches:
            found = [grammar.uses(x) for x in b["text"]]
            yield pd.DataFrame({"u": [[0.0] * USES if u is None else [round(x, 6) for x in u.tolist()] for u in found], "y": b["toxic"].astype(float)})

    points = rows.mapInPandas(uses, "u array<double>, y double").groupBy("u", "y").agg(F.count(F.lit(1)).alias("n")).collect()
    if not any(r["y"] for r in points) or all(r["y"] for r in points):
        return grammar
    return fitted(grammar, np.array([r["u"] for r in points]), np.array([r["y"] for r in points]), np.array([r["n"] for r in points], float))


def fitted(grammar: Grammar, u: np.ndarray, y: np.ndarray, n: np.ndarray, hold: float = 20.0, rounds: int = 12) -> Grammar:
    """``grammar`` with arc weights and curve fitted to uses ``u`` of ``n`` rows each with label ``y``.

    The weights' logarithms move by descent on the logistic loss, ``hold`` times their squared distance from the start
    added, as far as the loss falls; the curve is fitted anew for each trial.
    """
    start = np.log([grammar.negated, grammar.reported, grammar.addressed, grammar.threat])
    balance = np.where(y > 0, n / n[y > 0].sum(), n / n[y == 0].sum()) * 200

    def trial(theta):
        x = np.minimum(grammar.ceiling, u @ _use_weights(*np.exp(theta)))
        a, b = _curve(x, y, n)
        margin = np.where(y > 0, 1, -1) * (a + b * x)
        return float(balance @ np.logaddexp(0, -margin)) + hold * float(((theta - start) ** 2).sum()), a, b

    theta, best, step = start.copy(), trial(start), 0.4
    for _ in range(rounds):
        moves = [(trial(theta + d), theta + d) for k in range(4) for d in (step * np.eye(4)[k], -step * np.eye(4)[k])]
        found, to = min(moves, key=lambda m: m[0][0])
        if found[0] < best[0] - 1e-9:
            best, theta = found, to
        else:
            step /= 2
    negated, reported, addressed, threat = (float(x) for x in np.exp(theta))
    return replace(grammar, negated=negated, reported=reported, addressed=addressed, threat=threat, intercept=best[1], slope=best[2])


def _curve(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Logistic regression on one variable, classes weighted alike, by Newton steps."""
    n = np.where(y > 0, n / n[y > 0].sum(), n / n[y == 0].sum()) * 200
    X = np.c_[np.ones_like(x), x]
    w = np.array([-2.0, 1.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (n * (p - y)) + ridge * w
        H = (X * (n * p * (1 - p))[:, None]).T @ X + ridge * np.eye(2)
        step = np.linalg.solve(H, g)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 1e-3))


def _scores(grammar: Grammar):
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([grammar.score(x) for x in texts], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, grammar: Grammar | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    score = _scores(grammar or learn(docs, labels))
    return docs.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), score(text_of()).alias("score")) \
        .withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, grammar: Grammar | None = None) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns kept."""
    return docs.filter(_scores(grammar or learn(docs, labels))(text_of()) < threshold)
