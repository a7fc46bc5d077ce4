import random
import re
from hashlib import sha256
from zlib import crc32

import pytest

from panelweave.llm import turn_repair
from tests.conftest import SF

rng = random.Random(21)
SPACES = " \t\n\x0b\x0c\r"


def damage(rows):
    """(conv, turn, role, text) after damage, in plain Python."""
    out = []
    for c, n, r, t in rows:
        r, t = " " if r is None else r, " " if t is None else t
        kind = crc32(f"{' ' if c is None else c}:{' ' if n is None else n}".encode()) % 20
        if kind == 0:
            continue
        row = (c, n, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", t) if kind == 2 else t)
        out += [row, row] if kind == 3 else [row]
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, t in rows:
        s = t.strip(SPACES)
        out.append("blank" if not s else "duplicate" if (r, t) in seen else "" if s[-1] in ".!?" else "truncated")
        seen.add((r, t))
    return out


def cheapest_edits(rows, found):
    """Least (cost, audit) by relaxing all edits column by column, over the output's role initials."""
    best = {"": (0, "", ())}  # by pattern state: cost, audit, output
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}

    def grow(held, new):
        for s, v in new:
            if s not in held or v[:2] < held[s][:2]:
                held[s] = v

    def inserted(held):
        for _ in range(5):
            grow(held, [(follow[s], (c + 3, a + "I", (o, ({"u": "user", "a": "assistant"}[follow[s]], "")))) for s, (c, a, o) in list(held.items())])
        return held

    best = inserted(best)
    for (_, _, r, t), f in zip(rows, found, strict=True):
        after = {}
        for s, (c, a, o) in best.items():
            new = [(s, (c + 4, a + "D", o))]
            if f not in ("blank", "duplicate"):
                more = 3 * (f == "truncated")
                if (r[:1] == "s" and s == "") or (r[:1] and r[:1] == follow[s]):
                    new.append((r[:1], (c + more, a + "K", (o, (r, t)))))
                new.append((follow[s], (c + 3 + more, a + "R", (o, ({"u": "user", "a": "assistant"}[follow[s]], t)))))
            grow(after, new)
        best = inserted(after)
    cost, audit, chain = min(v for s, v in best.items() if s in ("", "a"))
    out = []
    while chain:
        chain, row = chain
        out.append(row)
    return cost, audit, out[::-1]


def brute(rows):
    kept, out = damage(rows), []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in kept if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        found = faults(mine)
        turns = {r[1] for r in mine if r[1] is not None}
        initials = [r[2][:1] for r in mine]
        cost, audit, repaired = cheapest_edits(mine, found)
        out.append(
            (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit)
            + (sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),)
        )
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, code int").repartition(5)
    return sorted((tuple(r) for r in turn_repair.report(turn_repair.damaged(df), df).collect()), key=str)


def conversations(n, longest):
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No", "Why? ", "ok.\n", "  ", "", "One. Two", "É!", f"word {turn}.", f"cut {turn}"])
            rows.append((c, turn, role, text))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_matches_plain_edits(spark, monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    rows = conversations(120, 14) + [(900, t, "user" if t % 3 else "assistant", f"line {t % 40}" + "." * (t % 2)) for t in range(300)]
    rows += [(None, 1, "user", "Hello."), (None, None, "assistant", "Hi."), (901, None, None, None), (901, 3, "user", None), (902, None, "user", "Only."), (903, 5, "x" * 10, "word " * 50_000)]
    assert got(spark, rows) == brute(rows)


def test_a_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(spark, rows) == brute(rows)


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "Well?"), (2, 0, "assistant", "cut")], "conv_id long, turn long, role string, text string")
    rows = turn_repair.in_order(df)
    found = turn_repair.audits(rows)
    assert {(r.conv_id, r.cost, r.audit) for r in found.collect()} == {(1, 7, "KDR"), (2, 4, "D")}
    turns = sorted(tuple(r) for r in turn_repair.repaired(rows, found).collect())
    assert turns == [(1, 0, "user", "Hi.", "K"), (1, 1, "assistant", "Well?", "R")]


def test_empty(spark):
    assert got(spark, []) == []
