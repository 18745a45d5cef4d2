"""Conversation structure repair by weighted interval parsing (CYK).

The roles of a sound conversation read ``(s?(ua)+)?`` by their initials.  Its
automaton has the states 0 (start), 1 (after s), 2 (after u) and 3 (after a); 0
and 3 accept.  The repair grammar in Chomsky normal form has a nonterminal
``<p,q>`` for every two states: the rules ``<p,r> -> <p,q> <q,r>``, and for each
single row ``<p,q>`` by an edit that takes p to q: Keep (cost 0), Rerole (2),
Delete (3, p = q).  Insert (2) is an edit of the empty span; the empty span's cells
are closed under it, and every row's cells take the closure in.  A cell holds the
least (cost, audit): the audit is the initials of the edits in order.  Equal
costs never come from audits of which one begins the other, so the least audit
of a span is made of the least audits of its halves.

Spans are combined bottom-up by length, 1, 2, 4 and so on.  A derivation of a
span has a state at every place in it, so one split gives the same cells as all
splits do, and a span needs one product of 4 x 4 cells.

Rows are ordered by turn (null first) and, inside a turn, by the SHA-256 of role
and text.  Equal rows are counted before anything is shuffled; rows that come
after an equal one are deleted, so their number is all that is needed.
Conversations are cut into pieces of ``TURNS`` turns, and where more than
``PIECE`` rows would meet, of one turn and a part of the hashes; pieces are parsed
on their own and their cells combined in order.  Only the kept texts are
shuffled.  What a conversation needs in one task is the cells of its pieces, as
a stream, since its audit is one string, and its digest, which reads the
repaired rows as a stream.

Defined cases: nulls in conv_id, turn, role and text count as one space, so rows
without an id form one conversation, whose id is null; an unknown or empty role
is no s, u or a and can be reroled; a conversation without rows has zeros, an
empty audit and the hash of the empty text; an empty table gives no rows; other
columns are left out.
"""
from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frames, sorted_groups, staged

TURNS = 1 << 10
PIECE = 1 << 15
WHITE = " \t\n\x0b\x0c\r"
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
KEEP, REROLE, DELETE, INSERT = (0, "K"), (2, "R"), (3, "D"), (2, "I")
#: A table of cells: for every state the (to, cost, audit) that are within reach.
Cells = tuple


def product(left: Cells, right: Cells) -> Cells:
    """``<p,r> -> <p,q> <q,r>`` for two neighbouring spans."""
    out = []
    for row in left:
        best: dict[int, tuple[int, str]] = {}
        for q, c, audit in row:
            for r, d, rest in right[q]:
                have = best.get(r)
                if have is None or c + d < have[0] or c + d == have[0] and audit + rest < have[1]:
                    best[r] = (c + d, audit + rest)
        out.append(tuple((r, *best[r]) for r in sorted(best)))
    return tuple(out)


def _closure() -> Cells:
    """Cells of the empty span: nothing, or insertions of user and assistant rows."""
    one = tuple(tuple([(p, 0, "")] + [(STEP[p, x], *INSERT) for x in "ua" if (p, x) in STEP]) for p in STATES)
    for _ in STATES:
        one = product(one, one)
    return one


EMPTY = _closure()


@lru_cache(maxsize=None)
def leaf(kind: str) -> Cells:
    """Cells of one row: ``x`` has to be deleted; s, u, a, or o for other roles, in capitals if truncated."""
    extra = int(kind.isupper())
    cells = []
    for p in STATES:
        edits = [(p, *DELETE)]
        if kind != "x":
            if (p, kind.lower()) in STEP:
                edits.append((STEP[p, kind.lower()], KEEP[0] + extra, KEEP[1]))
            edits += [(STEP[p, x], REROLE[0] + extra, REROLE[1]) for x in "ua" if (p, x) in STEP]
        cells.append(tuple(edits))
    return product(product(EMPTY, tuple(cells)), EMPTY)


@lru_cache(maxsize=100_000)
def _short(kinds: str) -> Cells:
    if len(kinds) == 1:
        return leaf(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return product(_short(kinds[:half]), _short(kinds[half:]))


def parse(kinds: str) -> Cells:
    """Cells of a span of rows, bottom-up by span length."""
    if not kinds:
        return EMPTY
    spans = [_short(kinds[i:i + 8]) for i in range(0, len(kinds), 8)]
    while len(spans) > 1:
        spans = [product(*spans[i:i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0]


def answer(cells: Cells) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    return min((c, audit) for q, c, audit in cells[0] if q in (0, 3))


def edits(audit: str, kinds_s: bool, before: int):
    """``(letter, output number, role to take or None)`` of each edit of a part of an audit.

    ``before`` rows come out before this part, and ``kinds_s`` tells whether the first of all is a system row.
    """
    n = before
    for e in audit:
        if e == "D":
            yield e, -1, None
            continue
        yield e, n, None if e == "K" else "user" if (n - kinds_s) % 2 == 0 else "assistant"
        n += 1


def text_or_space(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by the crc32 of ``conv_id:turn``, modulo 20; nulls become one space, ``turn`` stays."""
    k = F.crc32(F.concat_ws(":", text_or_space("conv_id"), text_or_space("turn")).cast("binary")) % 20
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text_or_space("role").alias("role"),
                        text_or_space("text").alias("text"), k.alias("_k")).filter("_k <> 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return named.select("conv_id", "turn", F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                        F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with their conversation ``c`` and turn ``t`` as text, and the hash ``h`` of role and text."""
    return rows.select(text_or_space("conv_id").alias("c"), text_or_space("turn").alias("t"), "turn", "role", "text",
                       F.sha2(F.concat_ws(":", "role", "text"), 256).alias("h"))


def entries(rows: DataFrame) -> DataFrame:
    """Groups of equal rows of a turn: ``n`` of them, and ``kind`` of the first, the others having to be deleted."""
    keyed = _keyed(rows)
    body = F.expr(f"rtrim('{WHITE}', text)")
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    kind = F.when(body == "", F.lit("x")).when(F.substring(body, -1, 1).isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    equal = keyed.select("c", "t", "turn", "h", first.alias("initial"), kind.alias("kind")) \
        .groupBy("c", "t", "turn", "h", "initial", "kind").agg(F.count(F.lit(1)).alias("n"))
    equal = staged(equal, "entries")
    earliest = equal.groupBy("c", "h").agg(F.min(F.struct("turn")).alias("least"))
    equal = equal.join(earliest, ["c", "h"]).withColumn("new", F.struct("turn") == F.col("least")).drop("least")
    # The pieces of a conversation, in order.
    lot = F.expr(f"(turn - pmod(turn, {TURNS}L)) div {TURNS}L")
    crowd = equal.groupBy("c", lot.alias("lot")).agg(F.count(F.lit(1)).alias("rows"))
    crowd = crowd.select(F.col("c").alias("_c"), F.col("lot").alias("_lot"), "rows")
    equal = equal.withColumn("lot", lot)
    equal = equal.join(crowd, (equal["c"] == crowd["_c"]) & equal["lot"].eqNullSafe(crowd["_lot"])).drop("_c", "_lot")
    tight = F.col("rows") > PIECE
    return staged(equal.withColumn("part", F.struct("lot", F.when(tight, F.col("turn")).alias("one"),
                                                    F.when(tight, F.substring("h", 1, 2)).alias("hash"))).drop("lot", "rows"), "entries")


def _spans(rows: list) -> tuple[str, int, int, int, int]:
    """Kinds of the rows of a piece, and how many are blank, duplicate, truncated and follow unlawfully."""
    kinds, blank, duplicate, truncated, illegal, before = [], 0, 0, 0, 0, None
    for initial, kind, n, new in rows:
        if before is not None:
            illegal += before + initial not in ("su", "ua", "au")
        illegal += n - 1
        before = initial
        if kind == "x":
            blank += n
            kinds.append("x" * n)
            continue
        duplicate += n - bool(new)
        if new:
            truncated += kind.isupper()
            kinds.append(kind)
        kinds.append("x" * (n - bool(new)))
    return "".join(kinds), blank, duplicate, truncated, illegal


PIECES = ("c string, p string, rows long, cells array<string>, blank long, duplicate long, truncated long, illegal long, "
          "first string, last string")


def written(cells: Cells) -> list[str]:
    return [f"{p} {q} {cost} {audit}" for p, row in enumerate(cells) for q, cost, audit in row]


def read_cells(lines) -> Cells:
    out: tuple = ([], [], [], [])
    for line in lines:
        p, q, cost, audit = line.split(" ")
        out[int(p)].append((int(q), int(cost), audit))
    return tuple(tuple(row) for row in out)


def _parse(batches):
    def out():
        for (c, p), group in sorted_groups(batches, 2):
            group = [r[2:] for r in group]
            kinds, *counts = _spans(group)
            yield c, p, len(kinds), written(parse(kinds)), *counts, group[0][0], group[-1][0]
    yield from frames(out(), ["c", "p", "rows", "cells", "blank", "duplicate", "truncated", "illegal", "first", "last"], 500)


SLICES = "array<struct<p:string,audit:string,before:long>>"
ANSWERS = f"c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, system int, slices {SLICES}"


def _fold(batches):
    """Combine the cells of a conversation's pieces, in order and evenly, and cut its audit at the pieces."""
    def out():
        for (c,), group in sorted_groups(batches, 1):
            stack, sizes, sums, last = [], [], [0, 0, 0, 0], None
            for _, p, rows, cells, blank, duplicate, truncated, illegal, first, end in group:
                level, cells = 0, read_cells(cells)
                while stack and stack[-1][0] == level:
                    cells, level = product(stack.pop()[1], cells), level + 1
                stack.append((level, cells))
                sizes.append((p, rows))
                illegal += last is not None and last + first not in ("su", "ua", "au")
                sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated, illegal))]
                last = end
            whole = stack.pop()[1]
            while stack:
                whole = product(stack.pop()[1], whole)
            cost, audit = answer(whole)
            parts, at, before = [], 0, 0
            for i, (p, rows) in enumerate(sizes):
                start = at
                while rows or i == len(sizes) - 1 and at < len(audit):
                    rows -= audit[at] != "I"
                    at += 1
                parts.append({"p": p, "audit": audit[start:at], "before": before})
                before += at - start - audit.count("D", start, at)
            yield c, *sums, cost, audit, before % 2, parts
    yield from frames(out(), ["c", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "system", "slices"], 500)


def _letters(batches):
    """Give every row of a piece its edit; a piece's first row is its part of the audit."""
    def out():
        for (c, _), group in sorted_groups(batches, 2):
            head = next(group)
            todo = edits(head[7], bool(head[8]), head[9])
            for _, _, t, h, kind, n, new, *_ in group:
                own = kind != "x" and bool(new)
                for k in range(n):
                    e, place, role = next(todo)
                    while e == "I":
                        yield c, None, None, place, role, e
                        e, place, role = next(todo)
                    if own and k == 0 and e != "D":
                        yield c, t, h, place, role, e
            for e, place, role in todo:
                yield c, None, None, place, role, e
    yield from frames(out(), ["c", "t", "h", "place", "role", "edit"], 5000)


def repairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repair the conversations of ``rows(conv_id, turn, role, text)``.

    Returns ``c, blank, duplicate, truncated, illegal, cost, audit`` of each conversation, and its repaired rows
    ``c, place, role, text, edit`` (``place`` from 0, ``edit`` K, R or I).  ``c`` is the id as text.
    """
    equal = entries(rows)
    name = F.to_json("part")
    index = Window.partitionBy("c").orderBy("part")
    # Pieces are numbered by their order; the numbers sort as text.
    parts = equal.select("c", "part").distinct().withColumn("p", F.lpad(F.row_number().over(index).cast("string"), 10, "0")) \
        .select(F.col("c").alias("_c"), name.alias("_part"), "p")
    equal = equal.withColumn("_name", name)
    equal = staged(equal.join(parts, (equal["c"] == parts["_c"]) & (equal["_name"] == parts["_part"])).drop("_c", "_part", "_name", "part"), "pieces")
    order = ["c", "p", "turn", "h"]
    cells = equal.repartition("c", "p").sortWithinPartitions(*order).select("c", "p", "initial", "kind", "n", "new").mapInPandas(_parse, PIECES)
    answers = staged(staged(cells, "cells").repartition("c").sortWithinPartitions("c", "p").mapInPandas(_fold, ANSWERS), "answers")
    heads = answers.select("c", "system", F.explode("slices").alias("s")).select(
        "c", F.col("s.p").alias("p"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("t"), F.lit("").alias("h"), F.lit("").alias("kind"),
        F.lit(0).cast("long").alias("n"), F.lit(False).alias("new"), F.col("s.audit").alias("audit"), "system", F.col("s.before").alias("before"), F.lit(0).alias("_row"))
    body = equal.select("c", "p", "turn", "t", "h", "kind", "n", "new", F.lit(None).cast("string").alias("audit"), F.lit(0).alias("system"),
                        F.lit(0).cast("long").alias("before"), F.lit(1).alias("_row"))
    sorted_rows = heads.unionByName(body).repartition("c", "p").sortWithinPartitions("c", "p", "_row", "turn", "h") \
        .select("c", "p", "t", "h", "kind", "n", "new", "audit", "system", "before")
    letters = staged(sorted_rows.mapInPandas(_letters, "c string, t string, h string, place long, role string, edit string"), "letters")
    texts = _keyed(rows).select("c", "t", "h", F.col("role").alias("own"), "text")
    kept = letters.filter("h is not null").join(texts, ["c", "t", "h"]).dropDuplicates(["c", "t", "h"]) \
        .select("c", "place", F.coalesce("role", "own").alias("role"), "text", "edit")
    new = letters.filter("h is null").select("c", "place", "role", F.lit("").alias("text"), "edit")
    return answers.drop("system", "slices"), kept.unionByName(new)


def _hash(batches):
    def out():
        for (c,), group in sorted_groups(batches, 1):
            h = hashlib.sha256()
            for k, (_, role, text) in enumerate(group):
                h.update(f"{chr(10) if k else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield c, h.hexdigest()
    yield from frames(out(), ["c", "repaired_sha256"])


def gaps(rows: DataFrame) -> DataFrame:
    """``c, gaps``: turns that are missing between the first and the last one."""
    turns = rows.select(text_or_space("conv_id").alias("c"), "turn").distinct()
    return turns.groupBy("c").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def conversation_repair(table: DataFrame) -> DataFrame:
    """Damage, repair and digest every conversation of ``table``."""
    rows = damaged(table)
    found, repaired = repairs(rows)
    digest = repaired.repartition("c").sortWithinPartitions("c", "place").select("c", "role", "text").mapInPandas(_hash, "c string, repaired_sha256 string")
    ids = table.select("conv_id").distinct().withColumn("c", text_or_space("conv_id"))
    out = ids.join(gaps(rows), "c", "left").join(found, "c", "left").join(digest, "c", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
