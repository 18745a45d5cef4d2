"""SentencePiece encoding and decoding with a prefix table of last tokens.

A BPE model of this kind merges, while it can, the neighbouring pair whose
joined text is the piece of the highest score, the leftmost of equals.  A
sequence of pieces is the encoding of its text exactly if every two neighbours
are the encoding of theirs (*compatible*): a merge across a boundary would come
at the same point of the two neighbours' own merges, which the rest of the text
doesn't change.  Every prefix of a text therefore has one last token, the only
piece that ends there and is compatible with the last token of the prefix
before it.  The table stores these last tokens from left to right, with the
matches of an Aho-Corasick automaton as candidates, and the ids are read from
its end backwards.  Time and memory are linear in the text.

Compatibility is tested on the two tokens' own merge histories (scores of the
next merge, first and last symbol of each step), so it holds for pieces of equal
scores and for pieces whose parts rank below them; results are cached per pair.

A space becomes U+2581, and one more precedes a text.  No piece goes on from a
letter to U+2581, from a letter to a mark or back, or over a character that
the vocabulary lacks; texts are cut there without a change, and cached segments
answer most of them.  Characters outside the vocabulary become their UTF-8
bytes' pieces.  Models need byte pieces, no normalisation and the dummy prefix.

Decoding joins the pieces' bytes, with U+2581 as a space and without the first
one; bytes that aren't UTF-8 become U+FFFD each, control pieces nothing.

Defined cases: null and empty texts are the begin and the end id alone and
decode to the empty text; rows with null or repeated ids are encoded like any
others; other columns stay as they are.
"""
from __future__ import annotations

import codecs
import re
import struct
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, trim

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CACHE = 250_000
DONE = float("-inf")
#: Marks, numbers, symbols and white space but for the space and the line break; a piece has either some of these or others,
#: beside its leading spaces.
MARKS = "\\x00-\t\x0b-\x1f!-@\\[-`{-\xbf\u2000-\u2580\u2582-\u2bff"


def _per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("harrow_per_byte", _per_byte)


class Pieces:
    """One model: ``encode`` and ``decode`` of whole texts; ids are little-endian 32-bit."""

    def __init__(self, name: str):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name) if "/" not in name else name)
        ids = range(m.get_piece_size())
        self.id = {m.id_to_piece(i): i for i in ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.score = {p: m.get_score(i) for p, i in self.id.items()}
        self.byte = {int(m.id_to_piece(i)[3:5], 16): i for i in ids if m.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the model has no byte pieces")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (m.bos_id(), m.eos_id()))
        self.surface = [b""] * len(ids)
        for p, i in self.id.items():
            self.surface[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.surface[i] = bytes([b])
        self.surface[m.unk_id()] = " ⁇ ".encode()
        self.led = np.array([p.startswith(SPACE) for p in map(m.id_to_piece, ids)])
        self.control = np.array([m.is_control(i) for i in ids])
        self.steps: dict[str, tuple] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if self.history(p)[3]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.cut = re.compile(self._segments())

    def _segments(self) -> str:
        """Segments that no piece crosses, of texts whose spaces aren't yet U+2581."""
        bodies = [p.lstrip(SPACE) for p in self.id]
        if any(SPACE in b for b in bodies):
            return "(?s).+"
        mark = re.compile(f"[{MARKS}]")
        if any(len({bool(mark.match(c)) for c in b}) > 1 for b in bodies):
            return "(?s) *[^ ]+| +"
        if any("\n" in b for b in bodies):
            return f" *[^{MARKS}\n ]+| *[{MARKS}\n]+| +"
        return f" *[^{MARKS}\n ]+|\n| *[{MARKS}]+| +"

    def history(self, token: str) -> tuple:
        """Steps of a token's own merging: score of the next merge, first and last symbol; whether it ends as one."""
        got = self.steps.get(token)
        if got is None:
            symbols, nexts, firsts, lasts = list(token), [], [], []
            while True:
                firsts.append(symbols[0])
                lasts.append(symbols[-1])
                scores = [self.score.get(a + b, DONE) for a, b in zip(symbols, symbols[1:])]
                best = max(scores, default=DONE)
                nexts.append(best)
                if best == DONE:
                    break
                k = scores.index(best)
                symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            got = self.steps[token] = (nexts, firsts, lasts, len(symbols) == 1)
        return got

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their joined text; of equal scores the leftmost merge comes first."""
        a, _, last, _ = self.history(left)
        b, first, _, _ = self.history(right)
        i = j = 0
        while True:
            across = self.score.get(last[i] + first[j], DONE)
            if across > a[i] and across >= b[j] and across != DONE:
                return False
            if a[i] == b[j] == DONE:
                return True
            if a[i] >= b[j]:
                i += 1
            else:
                j += 1

    def table(self, s: str) -> list:
        """The last token of each prefix of ``s`` (position 0 has none)."""
        last: list = [None] * (len(s) + 1)
        if not self.known.issuperset(s):
            # A character outside the vocabulary is a token that goes with any other.
            for i, c in enumerate(s):
                if c not in self.known:
                    last[i + 1] = c
        pairs = self.pairs
        for end, token in self.automaton.iter(s):
            end += 1
            if last[end] is None:
                start = end - len(token)
                if start:
                    before = last[start]
                    if before is None:
                        continue
                    row = pairs.get(before)
                    if row is None:
                        row = pairs[before] = {}
                    fits = row.get(token)
                    if fits is None:
                        fits = row[token] = self.compatible(before, token)
                    if not fits:
                        continue
                last[end] = token
        return last

    def segment(self, s: str) -> bytes:
        s = s.replace(" ", SPACE)
        last, out, at, ids = self.table(s), [], len(s), self.id
        while at:
            token = last[at]
            i = ids.get(token)
            if i is None:
                out.extend(self.byte[b] for b in reversed(token.encode("utf-8", "surrogatepass")))
            else:
                out.append(i)
            at -= len(token)
        out.reverse()
        return struct.pack(f"<{len(out)}I", *out)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, begin and end included."""
        if not text:
            return self.begin + self.end
        # U+2581 in a text is a space to the model.
        parts = self.cut.findall(" " + text.replace(SPACE, " "))
        cache = self.cache
        if len(cache) > CACHE:
            # Those met since the last time stay within reach.
            self.older, self.cache = cache, {}
            cache = self.cache
        older = self.older
        for s in set(parts).difference(cache):
            cache[s] = older.get(s) or self.segment(s)
        return b"".join([self.begin, *map(cache.__getitem__, parts), self.end])

    def decode(self, ids: bytes) -> str:
        out, at = [], 0
        i = np.frombuffer(ids, "<u4")
        # A control piece ends a run of bytes.
        for stop in [*np.flatnonzero(self.control[i]).tolist(), len(i)]:
            if stop > at:
                part = b"".join(map(self.surface.__getitem__, i[at:stop].tolist()))
                out.append((part if out or not self.led[i[at]] else part[1:]).decode("utf-8", "harrow_per_byte"))
            at = stop + 1
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(name: str) -> Pieces:
    return Pieces(name)


def encoded(text: Column, model: str = MODEL) -> Column:
    """Ids of ``text`` as binary: unsigned 32-bit numbers, little-endian."""
    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        p = pieces(model)
        out = pd.Series([p.encode(t) for t in texts], dtype=object)
        trim()
        return out

    return encode(F.coalesce(text, F.lit("")))


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of ids; null stays null."""
    @F.pandas_udf("string")
    def decode(rows: pd.Series) -> pd.Series:
        p = pieces(model)
        return pd.Series([None if r is None else p.decode(r) for r in rows], dtype=object)

    return decode(ids)


def with_pieces(docs: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the ids of their texts and what these decode to, under the given names."""
    out = docs.withColumn(ids, encoded(text_of(), model))
    return out.withColumn(text, decoded(F.col(ids), model))


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    return with_pieces(docs.select("doc_id", "text"), model, "_ids", "_decoded").select(
        "doc_id", (F.length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("_decoded").cast("binary"), 256).alias("decoded_sha256"))
