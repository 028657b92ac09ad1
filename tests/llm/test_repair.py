"""Repairs of conversations against all sequences of edits, and against plain strings for longer ones."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from conftest import DATA
from quirefold.llm.queries import QUERIES
from quirefold.llm.repair import Costs, Repair, damage, repaired, reports

LEGAL = re.compile("(s?(ua)+)?")
SOLID = re.compile("[^\x20\x09-\x0d]")
NAMES = {"u": "user", "a": "assistant"}


def judged(rows):
    """(role, text, fault) of rows (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        solid = SOLID.findall(text)
        out.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def every_repair(rows):
    """The cheapest edits by trying all of them, with two insertions at most at each place."""
    inserts = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for _, _, f in rows]
    for edits in itertools.product(*choices):
        paid = sum(4 if e == "D" else (3 if e[0] == "R" else 0) + (3 if f == "truncated" else 0) for e, (_, _, f) in zip(edits, rows))
        if best and paid > best[0]:
            continue
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            cost = paid + 3 * sum(map(len, places))
            if best and cost > best[0]:
                continue
            said, audit, out = [], "", []
            for k, place in enumerate(places):
                for i in place:
                    said.append(i)
                    audit += "I"
                    out.append(f"{NAMES[i]}:")
                if k < len(rows):
                    audit += edits[k][0]
                    if edits[k] != "D":
                        role = rows[k][0] if edits[k] == "K" else NAMES[edits[k][1]]
                        said.append(role[:1] or "?")
                        out.append(f"{role}:{rows[k][1]}")
            if LEGAL.fullmatch("".join(said)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(out))
    return best


def by_strings(rows):
    """The same by one pass that holds every path's whole label string and text."""
    moves = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    layer = {0: (0, "", ())}

    def spread(layer):
        layer, todo = dict(layer), list(layer)
        while todo:
            q = todo.pop()
            for i, to in moves[q].items():
                if i != "s":
                    way = (layer[q][0] + 3, layer[q][1] + "I", (*layer[q][2], f"{NAMES[i]}:"))
                    if to not in layer or way[:2] < layer[to][:2]:
                        layer[to] = way
                        todo.append(to)
        return layer

    for role, text, fault in rows:
        after = {}
        for q, (cost, audit, out) in spread(layer).items():
            ways = [(q, (cost + 4, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] in moves[q]:
                    ways.append((moves[q][role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                ways += [(to, (cost + more + 3, audit + "R", (*out, f"{NAMES[i]}:{text}"))) for i, to in moves[q].items() if i != "s"]
            for to, way in ways:
                if to not in after or way[:2] < after[to][:2]:
                    after[to] = way
        layer = after
    done = spread(layer)
    cost, audit, out = min(done[q] for q in (0, 3) if q in done)
    return cost, audit, "\n".join(out)


def by_machine(rows):
    one = Repair(Costs())
    for role, text, fault in rows:
        one.read(role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text)
    return one.result()


def test_every_short_repair():
    random.seed(2)
    for n in (0, 1, 2, 3):
        for _ in range(1 if not n else 60 if n < 3 else 40):
            rows = judged([(k, random.choice(["user", "assistant", "system", "tool", " "]), random.choice(["a.", "b", "", "c!"])) for k in range(n)])
            cost, audit, text = every_repair(rows)
            assert by_machine(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest()) and by_strings(rows) == (cost, audit, text)


def test_long_repairs():
    random.seed(5)
    for k in range(60):
        roles = [["user"], ["user", "assistant"], ["user", "assistant", "system", ""], ["assistant", "assistant", "user"]][k % 4]
        rows = judged([(n, random.choice(roles), random.choice(["", "x", *(f"t{n}{e}" for e in (".", "?", ""))])) for n in range(random.randint(5, 60))])
        cost, audit, text = by_strings(rows)
        assert by_machine(rows) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_ten_thousand_rows_of_one_role():
    rows = [("user", f"t{k}.", "") for k in range(10_001)]
    cost, audit, _ = by_machine(rows)
    assert (cost, audit) == (15_003, "KI" + "KR" * 5000)


def damaged(rows):
    """What damage() makes of rows (conv_id, turn, role, text), by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        here += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def wanted(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    of = judged(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults = [sum(f == kind for _, _, f in of) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, text = by_strings(of)
    return (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


ODD = [
    (None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 2, "user", "Hi."), (1, 1, "assistant", None), (2, 5, None, "x."), (3, 1, "", "no role."),
    (4, 1, "user", "long. " * 50_000), (4, 2, "assistant", "cut \x1c"), (5, 9, "user", " \t\n\x0b\x0c\r"), (6, 0, "user", "漢。"), (6, 1, "Assistant", "é!"), *((7, k % 50, "user", f"t{k % 90}.") for k in range(300)),
]


@pytest.mark.parametrize("broadcast", [True, False])
def test_odd_conversations(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr("quirefold.llm.repair.small", lambda *_: False)
    rows = spark.createDataFrame([(*r, 1, "x") for r in ODD], "conv_id long, turn long, role string, text string, fault int, digest string").repartition(4)
    harmed = damage(rows)
    got = {r.conv_id: tuple(r)[1:] for r in reports(harmed).collect()}
    assert got == {conv: wanted(here) for conv, here in damaged(ODD).items()}
    plain = {}
    for conv, *row in ODD:
        plain.setdefault(conv, []).append((row[0], row[1] if row[1] is not None else " ", row[2] if row[2] is not None else " "))
    assert {r.conv_id: tuple(r)[1:] for r in reports(rows).collect()} == {conv: wanted(here) for conv, here in plain.items()}
    assert reports(rows.limit(0)).collect() == []


def test_whole_table_and_repaired_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, DATA).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    assert got == {conv: wanted(here) for conv, here in damaged(rows).items()}
    harmed = damage(spark.read.parquet(f"{DATA}/conversations.parquet"))
    left = defaultdict(list)
    for r in repaired(harmed, reports(harmed)).orderBy("conv_id", "place").collect():
        left[r.conv_id].append(r)
    for conv, found in got.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left[conv]).encode()).hexdigest() == found[-1]
        assert LEGAL.fullmatch("".join(r.role[0] for r in left[conv])) and [r.place for r in left[conv]] == list(range(1, len(left[conv]) + 1))
        assert [r.edit for r in left[conv]] == [e for e in found[-2] if e != "D"]


def test_all_rows_dropped(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    (r,) = reports(damage(spark.createDataFrame([(lost, 0, "user", "Hello.")], "conv_id long, turn long, role string, text string"))).collect()
    assert tuple(r) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
