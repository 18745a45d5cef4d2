"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each
character; dynamic programming keeps the best score and the number of pieces
for every end, no back-pointers.  Ties follow the unigram tokenizers: a later
candidate replaces an earlier one only with a strictly better score, and
candidates of one end come in the order of their starts, so the longest last
piece wins.  A character that no piece covers alone is an unknown with the
lowest score of the vocabulary less ten; it counts as its UTF-8 bytes.

White space: a space becomes U+2581, and one more precedes the text.  No piece
goes from a letter on to U+2581, so the search splits there without a loss and
segments are cached; sums stay exact because scores are whole numbers.

The box holds no unigram model.  The vocabulary is that of a public BPE model
with the score ``-round(1000 * ln(rank + 2))``, a Zipf prior over its ranks.

Defined cases: null and empty texts have no tokens and score 0; rows with null
or repeated ids are counted like any others.
"""
from __future__ import annotations

import math
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN = 10
CACHE = 400_000
_FIELD = 40


@lru_cache(maxsize=2)
def vocabulary(name: str = VOCABULARY) -> tuple[tuple[str, int], ...]:
    """``(piece, score)`` of the ordinary pieces, in the order of their ranks."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name) if "/" not in name else name)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())
              if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return tuple((p, -round(1000 * math.log(r + 2))) for r, p in enumerate(pieces))


class Viterbi:
    """Counts over one vocabulary."""

    def __init__(self, pieces: tuple[tuple[str, int], ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.single = {p for p, _ in pieces if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) for p, _ in pieces):
            self.cut = re.compile(".+", re.S)
        else:
            known = "\n" if not any("\n" in p for p, _ in pieces) else ""
            self.cut = re.compile(f"{known}|{SPACE}*[^{SPACE}{known}]+|{SPACE}+" if known else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, int] = {}

    def segment(self, s: str) -> tuple[int, int]:
        """``(score, pieces)`` of the best way to write ``s``."""
        n = len(s)
        best: list = [None] * (n + 1)
        best[0] = (0, 0)
        at = 0
        single, unknown = self.single, self.unknown

        def close(upto: int) -> None:
            # Unknown characters come last among the candidates of their end.
            nonlocal at
            while at < upto:
                c = s[at]
                at += 1
                if c not in single:
                    score, k = best[at - 1]
                    if best[at] is None or score + unknown > best[at][0]:
                        best[at] = (score + unknown, k + len(c.encode("utf-8", "surrogatepass")))

        for end, (length, piece) in self.automaton.iter(s):
            end += 1
            close(end - 1)
            score, k = best[end - length]
            if best[end] is None or score + piece > best[end][0]:
                best[end] = (score + piece, k + 1)
        close(n)
        return best[n]

    def count(self, text: str) -> tuple[int, int]:
        """``(score, pieces)`` of a whole text."""
        if not text:
            return 0, 0
        parts = self.cut.findall(SPACE + text.replace(" ", SPACE))
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        for s in set(parts).difference(cache):
            score, k = self.segment(s)
            cache[s] = (-score << _FIELD) + k
        total = sum(map(cache.__getitem__, parts))
        return -(total >> _FIELD), total & ((1 << _FIELD) - 1)


@lru_cache(maxsize=2)
def _viterbi(name: str) -> Viterbi:
    return Viterbi(vocabulary(name))


def token_counts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, score`` of every row."""

    @F.pandas_udf("struct<score:double,n:long>")
    def count(texts: pd.Series) -> pd.DataFrame:
        v = _viterbi(name)
        got = [v.count(t) for t in texts]
        return pd.DataFrame({"score": [float(s) for s, _ in got], "n": [n for _, n in got]}).astype({"score": "float64", "n": "int64"})

    return docs.select("doc_id", count(text_of()).alias("c")).select("doc_id", F.col("c.n").alias("n_tokens"), "c.score")
