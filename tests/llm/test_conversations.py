"""Conversation repair against a plain program over whole edit strings."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nervemap.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain(rows):
    """Faults, and of all ways to repair the cheapest and then first, by state of the prefix: the whole edit string and text are carried along."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(C.SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = {r[1] for r in rows} - {None}
    initials = [r[2][:1] for r in rows]
    out = {f: faults.count(f) for f in ("blank", "duplicate", "truncated")}
    out["gaps"] = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    out["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def widen(best):
        for _ in range(3):
            for q, (cost, edits, lines) in list(best.items()):
                for r in step[q]:
                    if r != "s":
                        new = (cost + 3, edits + "I", lines + ({"u": "user", "a": "assistant"}[r] + ":",))
                        best[r] = min(best.get(r, new), new)
        return best

    best = {"": (0, "", ())}
    for (_, _, role, text), fault in zip(rows, faults):
        best, after = widen(best), {}
        for q, (cost, edits, lines) in best.items():
            ways = [(q, 4, "D", ())]
            if fault not in ("blank", "duplicate"):
                cut = 3 * (fault == "truncated")
                if role[:1] and role[:1] in step[q]:
                    ways.append((role[:1], cut, "K", (f"{role}:{text}",)))
                ways += [(r, 3 + cut, "R", ({"u": "user", "a": "assistant"}[r] + f":{text}",)) for r in step[q] if r != "s"]
            for r, more, edit, line in ways:
                new = (cost + more, edits + edit, lines + line)
                after[r] = min(after.get(r, new), new)
        best = after
    # a prefix that is dearer or later in order is so with whatever follows, but for prefixes of one another, which differ in cost
    best = widen(best)
    cost, audit, lines = min(best[q] for q in ("", "a") if q in best)
    return out | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def table():
    draw = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "tool", "", None, "user", "assistant"]
    texts = ["", " \n", None, "Yes.", "No", "Is it?  ", "so\x0b.", "été", "x" * 3000 + "!", " "]
    rows = []
    for conv in range(60):
        for i in range(int(draw.integers(1, 14))):
            turn = None if draw.random() < 0.08 else int(draw.integers(-3, 12)) if draw.random() < 0.3 else i
            rows.append((conv, turn, roles[draw.integers(len(roles))], texts[draw.integers(len(texts))] if draw.random() < 0.6 else f"turn {i}."))
    rows += [(None, 0, "user", "lost."), (None, None, None, None)]
    for i in range(700):  # several runs
        rows.append((900, i, ["user", "assistant"][i % 2] if draw.random() < 0.9 else "system", f"{i}." if draw.random() < 0.9 else texts[draw.integers(len(texts))]))
    return rows


def expected(rows):
    out = {c: dict.fromkeys(NUMBERS, 0) | {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()} for c in {r[0] for r in rows}}
    left = plain_damage(rows)
    return out | {c: plain([r for r in left if r[0] == c]) for c in {r[0] for r in left}}


def found(df):
    got = {}
    for r in df.collect():
        assert r["conv_id"] not in got
        got[r["conv_id"]] = {c: r[c] for c in (*NUMBERS, "audit", "repaired_sha256")}
    return got


def test_against_plain(spark):
    rows = table()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("at", "conv", "_pos", "fault", "edit", "_c", "size")})
    assert found(C.audit_damaged(df)) == expected(rows)


def test_stretches(spark):
    """Runs and stretches of any length give the same."""
    rows = [r for r in table() if r[0] is not None]
    df = spark.createDataFrame([r for r in plain_damage(rows)], SCHEMA).repartition(2)
    repair = C.Repair(df, run=7, chunk=50)
    digests = dict(map(tuple, repair.digests().collect()))
    got = {r["conv_id"]: {c: r[c] for c in (*NUMBERS, "audit")} | {"repaired_sha256": digests[r["conv_id"]]} for r in repair.audits().collect()}
    assert got == {c: x for c, x in expected(rows).items() if c in got} and set(got) == {r[0] for r in plain_damage(rows)}


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why"), (2, 0, "user", ""), ("3", 0, "system", "Be kind."), ("3", 1, "user", "Yes.")]
    rows = [(str(c), t, r, x) for c, t, r, x in rows]
    got = C.Repair(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).repaired().orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [
        ("1", 0, None, "user", "", "I"), ("1", 1, 0, "assistant", "Hello.", "K"),
        ("3", 0, 0, "system", "Be kind.", "K"), ("3", 1, 1, "user", "Yes.", "K"), ("3", 2, None, "assistant", "", "I"),
    ]


def test_no_rows(spark):
    assert C.audit_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "a.")], SCHEMA)
    assert found(C.audit_damaged(df)) == expected([(gone, 0, "user", "a.")])


@pytest.mark.parametrize("width", [1, 5, 40])
def test_traces_in_pieces(width):
    """Costs multiplied up over pieces are those of the whole."""
    draw = np.random.default_rng(width)
    symbols = draw.integers(0, 12, 200).astype(np.uint8)
    whole, = C.traces([symbols.tobytes()], C._END[None])
    parts = [symbols[i : i + width].tobytes() for i in range(0, 200, width)]
    m = C.transfers(parts)
    leaving, cost = [], C._END
    for x in m[::-1]:
        leaving.append(cost)
        cost = (x + cost[None]).min(axis=1)
    state, codes, total = 0, [], 0
    for c, after, spent in C.traces(parts, np.array(leaving[::-1])):
        codes += c[state].tolist()
        total, state = total + spent[state], after[state]
    assert codes == whole[0][0].tolist() and state == whole[1][0] and total == whole[2][0]
