import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lendmend.llm import conversations as c
from lendmend.llm.queries import op11_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
ROLES = ["user", "assistant", "system", "tool", None, "", "usr"]
TEXTS = ["a.", "b?", "c", "", None, " \n", "d! ", "long text.", "e ", " "]


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(turns):
    """(cost, edits, repaired turns) by backward recursion over all states; ``turns`` are (role, text, fault)."""
    after = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}

    def inserts(best):
        for _ in range(3):
            for q, (role, to) in after.items():
                if best[to] is not None:
                    new = (best[to][0] + 3, "I" + best[to][1], ((role, ""), *best[to][2]))
                    if best[q] is None or new[:2] < best[q][:2]:
                        best[q] = new
        return best

    best = inserts([(0, "", ()), None, None, (0, "", ())])
    for role, text, fault in reversed(turns):
        now = []
        for q, (name, to) in after.items():
            ways = []
            if best[q] is not None:
                ways.append((best[q][0] + 4, "D" + best[q][1], best[q][2]))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                ways.append((best[to][0] + 3 + more, "R" + best[to][1], ((name, text), *best[to][2])))
                if role[:1] == name[0]:
                    ways.append((best[to][0] + more, "K" + best[to][1], ((role, text), *best[to][2])))
                if q == 0 and role[:1] == "s":
                    ways.append((best[1][0] + more, "K" + best[1][1], ((role, text), *best[1][2])))
            now.append(min(ways, key=lambda w: w[:2], default=None))
        best = inserts(now)
    return best[0]


def brute(given, rows):
    of = defaultdict(list)
    for conv, *turn in rows:
        of[conv].append(turn)
    out = set()
    for conv in {r[0] for r in given}:
        turns, seen = [], set()
        own = sorted(of[conv], key=lambda r: (r[0] is not None, r[0] or 0))
        for _, role, text in own:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            turns.append((role, text, fault))
            seen.add((role, text))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        known = {r[0] for r in own if r[0] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        cost, audit, kept = cheapest(turns)
        counts = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        out.add((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return out


def reported(df, turns=None, **options):
    return {tuple(r) for r in c.reports(c.repair_conversations(df if turns is None else turns, **options), df).collect()}


def some(seed, convs, n, odd=0.4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        role = rng.choice(ROLES) if rng.random() < odd else ("user", "assistant")[i % 2]
        text = (rng.choice(TEXTS) or "") + rng.choice(["", f".{i}."])
        rows.append((None if rng.random() < 0.02 else rng.randrange(convs), i, role, rng.choice([text, None]) if rng.random() < 0.1 else text))
    return rows


def test_equals_brute_force(spark, saved):
    rows = some(1, 200, 2500) + [(500, None, "user", "x."), (501, None, None, None), (501, None, None, None)]
    df = spark.read.parquet(f"{saved(conversations=(rows, SCHEMA))}/conversations.parquet")
    assert reported(df, c.damaged(df)) == brute(rows, hurt(rows))


@pytest.mark.parametrize("block_turns", [1, 7, 4096])
def test_a_conversation_of_many_blocks(spark, saved, block_turns):
    rows = [(1, *r[1:]) for r in some(2, 1, 700, odd=0.2)] + [(2, 5, "user", "Hi."), (2, 9, "assistant", "Ho.")] + [(3, 2 * i, "system", "same") for i in range(150)]
    df = spark.read.parquet(f"{saved(conversations=(rows, SCHEMA))}/conversations.parquet")
    given = [(a, b, " " if r is None else r, " " if t is None else t) for a, b, r, t in rows]
    assert reported(df, block_turns=block_turns) == brute(rows, given)


def test_auctions_by_stretch_give_the_least_edits(monkeypatch):
    rng = random.Random(7)
    names = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    for k in range(400):
        monkeypatch.setattr(c, "STRETCH", rng.choice([1, 2, 5, 32]))
        turns = [(rng.choice("suax" if k % 2 else "ua"), rng.choice([c.FINE, c.FINE, c.CUT_OFF, c.GONE])) for _ in range(rng.randint(1, 14))]
        want = cheapest([(names[i], "t", [None, "truncated", "blank"][d]) for i, d in turns])
        letters, end = c.ways(turns, c.LAST, [c.START])[c.START]
        assert letters + "I" * (c.LAST[end] // c.INSERT) == want[1]
        assert c.solved(turns, c.LAST, [c.START])[0].price[0][c.START] == want[0]
        table = c.costs(turns)
        assert min(table[q] + c.LAST[q] for q in c.STATES) == want[0]


def test_prices_never_exceed_what_an_arc_offers():
    rng = random.Random(9)
    for _ in range(100):
        turns = [(rng.choice("suax"), rng.choice([c.FINE, c.CUT_OFF, c.GONE])) for _ in range(12)]
        lattice = c.Lattice(turns, c.LAST)
        lattice.cost(c.START)
        for i in range(12):
            for q in c.STATES:
                assert all(lattice.price[i][q] <= cost + lattice.price[j][r] for _, cost, j, r in lattice.arcs(i, q))


def test_edits_carry_turns_and_texts(spark, saved):
    rows = [(1, 0, "user", "Hello."), (1, 2, "user", "And?"), (1, 3, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    df = spark.read.parquet(f"{saved(conversations=(rows, SCHEMA))}/conversations.parquet")
    got = c.repair_conversations(df).orderBy("block", "place", "step").select("edit", "turn", "role", "text", "fault", "cost").collect()
    assert [tuple(r) for r in got] == [
        ("K", 0, "user", "Hello.", None, 0), ("I", None, "assistant", "", None, 3), ("K", 2, "user", "And?", None, 0),
        ("K", 3, "assistant", "Yes.", None, 0), ("D", 3, None, None, 2, 4),
    ]


def test_query(spark, saved):
    rows = [(k, i, ("user", "assistant")[i % 2], f"Turn {i}, {k}.") for k in range(40) for i in range(k % 5)] + [(77, 3, "user", "gone or not.")]
    extra = [(*r, "x", 1) for r in rows]
    got = op11_conversations(spark, saved(conversations=(extra, SCHEMA + ", grp string, block int")))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got.collect()} == brute(rows, hurt(rows))
    assert op11_conversations(spark, saved(conversations=([], SCHEMA))).collect() == []
