"""Conversation repair against every edit script of small conversations."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from gleaner.llm import repair as module
from gleaner.llm.repair import damaged, judge, least_weights, repair, repair_report

SCHEMA = "conv_id long, turn long, role string, text string, seen string, `a.b` int, n string"
PATTERN = re.compile("(s?(ua)+)?")
ROLES = {"u": "user", "a": "assistant"}
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows):
    """(cost, audit, repaired rows): all scripts of at most two rows inserted in each place, by brute force."""
    faults, earlier = [], set()
    for role, text in rows:
        solid = BLANK.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in earlier else "truncated" if solid[-1] not in ".!?" else "")
        earlier.add((role, text))
    options = []
    for (role, text), fault in zip(rows, faults):
        own = [(4, "D", "", [])]
        if fault not in ("blank", "duplicate"):
            more = 3 * (fault == "truncated")
            own.append((more, "K", role[:1] or "?", [(role, text)]))
            own += [(3 + more, "R", r, [(ROLES[r], text)]) for r in "ua"]
        options.append(own)
    blanks = [(3 * len(x), "I" * len(x), "".join(x), [(ROLES[r], "") for r in x]) for n in range(3) for x in product("ua", repeat=n)]
    spread = [blanks]
    for own in options:
        spread += [own, blanks]
    states = {("",): (0, "", [])}
    paths = [(0, "", "", [])]
    for choice in spread:
        paths = [(c + x, a + y, i + z, r + k) for c, a, i, r in paths for x, y, z, k in choice if c + x <= 4 * len(rows)]
        # every different (audit, initials) is kept; only equal ones are merged
        paths = list({(p[1], p[2]): p for p in paths}.values())
    assert states
    found = [p for p in paths if PATTERN.fullmatch(p[2])]
    cost, audit, _, repaired = min(found, key=lambda p: (p[0], p[1]))
    return cost, audit, repaired, faults


def report(rows):
    """The contract's row for rows of (turn, role, text) in order."""
    cost, audit, repaired, faults = cheapest([r[1:] for r in rows])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha


def order(row):
    return row[0] is not None, row[0] or 0, row[1], row[2]


def conversations(draw, n, longest=4):
    out = {}
    for c in range(n):
        rows = [
            (draw.choice([None, *range(5)]), draw.choice(["user", "assistant", "system", "tool", "", " ", "Assistant"][: draw.choice([2, 3, 7])]),
             draw.choice(["Yes.", "No!", "what", " \n", "", "Good? ", "end.\x0b"]))
            for _ in range(draw.randint(0, longest))
        ]
        out[c] = sorted(rows, key=order)
    return out


def test_against_all_scripts(spark):
    wanted = conversations(random.Random(11), 150)
    original = spark.createDataFrame([(c, None, None, None, "x", 1, "n") for c in wanted], SCHEMA)
    table = spark.createDataFrame([(c, *r, "x", 1, "n") for c, rows in wanted.items() for r in rows], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair_report(original, table).collect()}
    assert got == {c: report(rows) if rows else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, rows in wanted.items()}


@pytest.mark.parametrize("block", [1, 3])
def test_cut_conversations(spark, monkeypatch, block):
    """Blocks chained by their weights give what the whole conversation gives."""
    draw = random.Random(block)
    for _ in range(300):
        rows = [judge(draw.choice(["user", "assistant", "system", "x"]), draw.choice(["a.", "b", "", "c?"]), draw.choice([1, 1, 1, 3]), draw.random() < 0.1)[:3] for _ in range(draw.randint(1, 12))]
        chain = module._Chain(1)
        for at in range(0, len(rows), block):
            paths = [{"q": q, "to": to, "cost": f[0], "audit": f[1]} for q in range(4) for to, f in enumerate(least_weights(rows[at : at + block], q)) if f]
            chain.add({"paths": paths, "block": at, "bin": 0, "first_role": "u", "last_role": "u", "low_turn": None, "high_turn": None, "turns": 0, **dict.fromkeys(chain.counts, 0)})
        summary, *parts = chain.rows()
        whole = least_weights(rows, 0)
        best = min((whole[q] for q in (0, 3) if whole[q]), key=lambda f: f)
        assert (summary["cost"], summary["audit"]) == best
        assert "".join(p["audit"] for p in reversed(parts)) == summary["audit"]


def test_long_conversation_is_not_one_group(spark, monkeypatch):
    """20,000 turns in partitions of their own: no block and no bin beyond its bound, result by the plain minimum."""
    draw = random.Random(5)
    rows = [(t, draw.choice(["user", "assistant"]), f"turn {t}" + draw.choice([".", ".", "?", ""])) for t in range(20_000)]
    table = spark.createDataFrame([(7, *r, "x", 1, "n") for r in rows] + [(8, 0, "user", "Hi.", "x", 1, "n"), (8, 1, "assistant", "Ho.", "x", 1, "n")], SCHEMA).repartition(6)
    edits, summary = repair(table)
    got = {r.conv_id: r for r in summary.collect()}
    assert got[8].audit == "KK" and got[8].cost == 0
    items = [judge(r, t, 1, False)[:3] for _, r, t in rows]
    # costs alone, by a plain table
    at = {0: 0}
    for initial, cost, _ in items:
        at = closed(at)
        now = {}
        for q, c in at.items():
            offers = [(q, c + 4)] + [(module._NEXT[q][r], c + cost + 3 * (r != initial)) for r in module._NEXT[q] if r == initial or r in "ua"]
            for to, value in offers:
                now[to] = min(now.get(to, value), value)
        at = now
    assert got[7].cost == min(v for q, v in closed(at).items() if q in (0, 3))
    letters = [r.edit for r in edits.filter("conv_id = 7").orderBy("block", "place").collect()]
    assert "".join(letters) == got[7].audit
    kept = [r.role[0] for r in edits.filter("conv_id = 7 AND edit <> 'D'").orderBy("block", "place").collect()]
    assert PATTERN.fullmatch("".join(kept))


def closed(at):
    at = dict(at)
    for _ in range(4):
        for q, c in list(at.items()):
            for r, to in module._NEXT[q].items():
                if r in "ua":
                    at[to] = min(at.get(to, c + 3), c + 3)
    return at


def test_hot_row_is_counted_once(spark):
    table = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 1, "n")] * 500 + [(1, 1, "assistant", "Ho.", "x", 1, "n")] + [(None, None, None, None, "x", 1, "n")] * 2, SCHEMA)
    got = {r.conv_id: r for r in repair_report(table, table).collect()}
    assert got[1].audit == "K" + "D" * 499 + "K" and (got[1].duplicate, got[1].cost, got[1].illegal) == (499, 4 * 499, 499)
    assert (got[None].blank, got[None].audit, got[None].gaps, got[None].illegal) == (2, "DD", 0, 1)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(12) for t in range(12)] + [(None, 3, None, None), (4, None, "user", None)]
    table = spark.createDataFrame([(*r, "x", 1, "n") for r in rows], SCHEMA)
    wanted = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        wanted += [(c, t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    assert sorted(map(tuple, damaged(table).collect()), key=repr) == sorted(wanted, key=repr)


def test_nothing(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert repair_report(table, table).collect() == []
    edits, summary = repair(table)
    assert edits.collect() == [] and summary.collect() == []
