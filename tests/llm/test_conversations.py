import hashlib
import itertools
import random
import re
import zlib

import pytest

from harrow.llm import cykrepair

TABLE = "conv_id long, turn long, role string, text string"
SOUND = re.compile("(s?(ua)+)?")
WHITE = " \t\n\x0b\x0c\r"


def every_repair(kinds):
    """All ways to edit rows of these kinds, with at most two insertions at each place: (cost, audit, roles)."""
    inserted = ["", "u", "a", "ua", "au"]
    for places in itertools.product(inserted, repeat=len(kinds) + 1):
        base = 2 * sum(map(len, places))
        for choice in itertools.product("KuaD", repeat=len(kinds)):
            cost, audit, roles = base, "I" * len(places[0]), places[0]
            for kind, c, more in zip(kinds, choice, places[1:]):
                if c != "D" and kind == "x" or c == "K" and kind in "oO":
                    break
                cost += {"K": 0, "D": 3}.get(c, 2) + (c != "D" and kind.isupper())
                roles += ("" if c == "D" else kind.lower() if c == "K" else c) + more
                audit += (c if c in "KD" else "R") + "I" * len(more)
            else:
                if SOUND.fullmatch(roles):
                    yield cost, audit


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_spans_against_all_repairs(n):
    for kinds in itertools.product("suaoSUAx" if n < 3 else "suaUx", repeat=n):
        got = cykrepair.answer(cykrepair.parse("".join(kinds)))
        assert got == min(every_repair(kinds)), kinds


def serial(kinds):
    """Least cost and audit, one row after the other."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def insert(best):
        for _ in range(4):
            for p, x in [(p, x) for p in list(best) for x in "ua" if (p, x) in step]:
                q, new = step[p, x], (best[p][0] + 2, best[p][1] + "I")
                best[q] = min(best.get(q, new), new)
        return best

    best = insert({0: (0, "")})
    for kind in kinds:
        now, extra = {}, int(kind.isupper())
        for p, (c, audit) in best.items():
            ways = [(p, c + 3, audit + "D")]
            if kind != "x":
                ways += [(step[p, x], c + 2 + extra, audit + "R") for x in "ua" if (p, x) in step]
                if (p, kind.lower()) in step:
                    ways.append((step[p, kind.lower()], c + extra, audit + "K"))
            for q, k, a in ways:
                now[q] = min(now.get(q, (k, a)), (k, a))
        best = insert(now)
    return min(best[q] for q in (0, 3) if q in best)


def test_any_split_gives_the_same_cells():
    rng = random.Random(3)
    for _ in range(300):
        kinds = "".join(rng.choice("suaoSUAOx" if rng.random() < 0.3 else "ua") for _ in range(rng.randrange(1, 60)))
        whole = cykrepair.parse(kinds)
        k = rng.randrange(len(kinds) + 1)
        assert cykrepair.product(cykrepair.parse(kinds[:k]), cykrepair.parse(kinds[k:])) == whole
        assert cykrepair.answer(whole) == serial(kinds)


def brute(rows):
    """The contract, conversation by conversation."""
    one = lambda x: " " if x is None else str(x)
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    for cid, group in groups.items():
        after = []
        for _, turn, role, text in group:
            role, text = one(role), one(text)
            k = zlib.crc32(f"{one(cid)}:{one(turn)}".encode()) % 20
            if k:
                text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
                after += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{r[1]}:{r[2]}".encode()).hexdigest()))
        turns = {t for t, _, _ in after if t is not None}
        faults, seen, kinds = [], set(), ""
        for _, role, text in after:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            kind = role[0] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        initials = [role[:1] for _, role, _ in after]
        cost, audit = serial(kinds) if after else (0, "")
        system, lines, rest = (len(audit) - audit.count("D")) % 2, [], iter(after)
        for e in audit:
            row = next(rest) if e != "I" else (None, "", "")
            if e != "D":
                role = row[1] if e == "K" else "user" if (len(lines) - system) % 2 == 0 else "assistant"
                lines.append(f"{role}:{row[2]}")
        out.append((cid, max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(rng, conversations):
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, 14)):
            role = "user" if t % 2 == 0 else "assistant"
            if rng.random() < 0.2:
                role = rng.choice(["system", "user", "assistant", "tool", "", None, "Üser"])
            text = rng.choice(["a b.", "c", "d!", "e? ", " \t", None, "x\ny.", "€", "f . \x0b"])
            rows.append((c, None if rng.random() < 0.04 else t + rng.randrange(2), role, text))
    rows += [(None, t, "user", f"q{t}?") for t in range(4)] + [(7000, None, "system", None)] + [rows[3]] * 3
    rows += [(8000, t, "user" if t % 2 == 0 else "assistant", f"t{t}.") for t in range(300)]
    return rows


def test_tables_against_brute_force(spark):
    rows = random_rows(random.Random(5), 150)
    df = spark.createDataFrame(rows, TABLE)
    for c in ("c", "h", "p", "kind", "n", "cost", "place", "part"):
        df = df.withColumn(c, df["role"])
    got = sorted(map(tuple, cykrepair.conversation_repair(df.repartition(5)).collect()), key=str)
    assert got == brute(rows)


def test_conversations_in_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(cykrepair, "TURNS", 16)
    monkeypatch.setattr(cykrepair, "PIECE", 9)
    rng = random.Random(6)
    rows = random_rows(rng, 3) + [(9000, 4, rng.choice(["user", "assistant"]), f"{k % 40}.") for k in range(120)]
    got = sorted(map(tuple, cykrepair.conversation_repair(spark.createDataFrame(rows, TABLE)).collect()), key=str)
    assert got == brute(rows)


def test_no_rows(spark):
    assert cykrepair.conversation_repair(spark.createDataFrame([], TABLE)).count() == 0
    # A conversation whose only row is dropped by the damage.
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = cykrepair.conversation_repair(spark.createDataFrame([(gone, 0, "user", "a.")], TABLE)).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
