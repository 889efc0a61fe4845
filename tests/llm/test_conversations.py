import hashlib
import re
import zlib
from itertools import product

import numpy as np
import pytest

from terrane.llm import conversations as C

SPACE = " \t\n\x0b\x0c\r"


def judged(rows):
    """(initial, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        core = text.strip(SPACE)
        fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def cheapest(faults):
    """(cost, edits) by keeping the least whole string per state."""
    insert = {"": "u", "s": "u", "a": "u", "u": "a"}

    def grow(ways):
        ways = dict(ways)
        for _ in range(2):
            for s, (cost, text) in list(ways.items()):
                new = (cost + 5, text + "I")
                if insert[s] not in ways or new < ways[insert[s]]:
                    ways[insert[s]] = new
        return ways

    ways = grow({"": (0, "")})
    for initial, fault in faults:
        new = {}
        for s, (cost, text) in ways.items():
            options = [(s, 2, "D")]
            if fault not in ("blank", "duplicate"):
                pay = 5 * (fault == "truncated")
                if initial == "s" and s == "" or initial and initial in "ua" and initial == insert[s]:
                    options.append((initial, pay, "K"))
                options.append((insert[s], pay + 1, "R"))
            for t, more, letter in options:
                way = (cost + more, text + letter)
                if t not in new or way < new[t]:
                    new[t] = way
        ways = grow(new)
    return min(ways[s] for s in ("", "a") if s in ways)


def replay(rows, edits):
    out, at = [], 0
    for letter in edits:
        last = out[-1][0] if out else ""
        other = "assistant" if last.startswith("u") else "user"
        if letter == "I":
            out.append((other, ""))
            continue
        role, text = rows[at]
        at += 1
        if letter != "D":
            out.append((role if letter == "K" else other, text))
    assert at == len(rows)
    return out


def expected(table):
    """conv_id -> report row, from (conv_id, turn, role, text) rows."""
    convs = {}
    for conv, turn, role, text in table:
        mine = convs.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        drawn = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if drawn == 0:
            continue
        text = "" if drawn == 1 else re.sub("[.!?]", "", text) if drawn == 2 else text
        mine += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    out = {}
    for conv, mine in convs.items():
        mine = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0))
        rows = [r[1:] for r in mine]
        faults = judged(rows)
        cost, edits = cheapest(faults)
        turns = [r[0] for r in mine if r[0] is not None]
        initials = [i for i, _ in faults]
        fixed = replay(rows, edits)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in fixed))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(f == k for _, f in faults) for k in C.FAULTS),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, edits,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest(),
        )
    return out


def reported(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_report_matches_brute_force(spark, sf):
    turns = spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    assert reported(C.repair_report(turns)) == expected(rows)


def test_every_short_conversation_by_enumeration():
    kinds = [("s", ""), ("u", ""), ("a", ""), ("t", ""), ("u", "truncated"), ("a", "blank"), ("u", "duplicate")]
    codes = {"s": 0, "u": 1, "a": 2, "t": 3}
    faults = {"": 0, "truncated": 1, "blank": 2, "duplicate": 3}
    for n in range(3):
        scripts = [
            "".join(gap + op for gap, op in zip(gaps, (*ops, ""))) for ops in product("DKR", repeat=n) for gaps in product(("", "I", "II"), repeat=n + 1)
        ]
        for rows in product(kinds, repeat=n):
            best = None
            for script in scripts:
                cost, out, at = 0, "", 0
                for letter in script:
                    if letter == "I":
                        cost, out = cost + 5, out + ("a" if out.endswith("u") else "u")
                        continue
                    initial, fault = rows[at]
                    at += 1
                    if letter == "D":
                        cost += 2
                    elif fault in ("blank", "duplicate"):
                        break
                    else:
                        cost += 5 * (fault == "truncated") + (letter == "R")
                        out += initial if letter == "K" else "a" if out.endswith("u") else "u"
                else:
                    if re.fullmatch("(s?(ua)+)?", out) and (best is None or (cost, script) < best):
                        best = (cost, script)
            text = "".join(chr(65 + codes[i] + 4 * faults[f]) for i, f in rows)
            assert C.chain([C.block_ways(text)]) == best == cheapest(rows)


def test_blocks_of_any_cut_agree():
    rng = np.random.default_rng(5)
    for trial in range(60):
        n = int(rng.integers(1, 60))
        text = "".join(chr(65 + int(c)) for c in rng.choice([0, 1, 1, 1, 2, 3, 5, 6, 9, 13], n))
        whole = C.chain([C.block_ways(text)])
        cuts = sorted({0, n, *rng.integers(0, n + 1, 4).tolist()})
        assert C.chain([C.block_ways(text[a:b]) for a, b in zip(cuts, cuts[1:])]) == whole
        names = {0: "", 1: "truncated", 2: "blank", 3: "duplicate"}
        assert whole == cheapest([("sua?"[(ord(c) - 65) % 4], names[(ord(c) - 65) // 4]) for c in text])


def test_equal_hashes_are_verified():
    tree = C.AuditTree()
    a, b = tree.add(0, "K"), tree.add(0, "D")
    x, y = tree.add(a, "R"), tree.add(b, "R")
    tree.hash[b], tree.hash[y] = tree.hash[a], tree.hash[x]  # a collision
    assert not tree.same(a, b) and not tree.same(x, y) and tree.first_difference(x, y) == 1
    assert tree.less(y, "K", x, "D")
    twin = tree.add(tree.add(0, "K"), "R")
    assert tree.same(x, twin) and tree.first_difference(x, twin) == 0 and tree.less(x, "D", twin, "K")
    # KI + D… against K + R…: a label that goes on with an insert is compared with the next label
    p, q = tree.add(0, "KI"), tree.add(0, "K")
    assert tree.less(p, "D", q, "R") and tree.less(q, "D", p, "D")


def test_long_conversation_of_many_blocks(spark):
    n = 7000
    rows = [(1, i, "user" if i % 7 else "assistant", f"words of turn {i}." if i % 5 else "again and again.") for i in range(n)]
    rows += [(2, i, "user", "the same.") for i in range(3000)]
    rows += [(3, 0, "system", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    assert C._codes(df).filter("conv_id = 1").count() > 2
    assert reported(C.repair_report(df)) == expected(rows)


CLASH = "audit string, conv_id {kind}, turn long, role string, text string, h1 string, block int, cost string, first string, seq long"


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [
        (None, None, None, None), (None, 3, "user", "ok."), (5, None, "user", "hello."), (5, None, "user", "hello."), (5, 1, "", "no role."), (5, 2, "tool", "t."),
        (6, 1, "user", " \t\n"), (6, 1, "user", " \t\n"), (6, 4, None, "a."), (7, 9, "assistant", "only"), (8, 0, "system", "s."), (8, 1, "User", "u."),
        (9, 1, "user", "é" * 10 + "!"), (9, 1, "user", "é" * 10 + "!"), (-4, -(2**40), "user", "a?"), (-4, 2**40, "assistant", "b?"),
    ]
    df = spark.createDataFrame([("x", *r, "y", 1, "z", "w", 2) for r in rows], CLASH.format(kind="long"))
    assert reported(C.repair_report(df)) == expected(rows)
    assert reported(C.repair_report(df.limit(0))) == {}
    named = [(f"c{r[0]}", *r[1:]) for r in rows]
    df = spark.createDataFrame([("x", *r, "y", 1, "z", "w", 2) for r in named], CLASH.format(kind="string"))
    assert reported(C.repair_report(df)) == expected(named)


def test_conversation_without_rows(spark):
    conv = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, 0, "user", "gone.")], "conv_id long, turn int, role string, text string")
    assert reported(C.repair_report(df)) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "tool", "c."), (2, 0, "assistant", "d."), (2, 1, "assistant", "e.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(C.repaired(df, C.audit(df)).collect())
    for conv in (1, 2):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        fixed = replay(mine, cheapest(judged(mine))[1])
        assert [(g.role, g.text) for g in got if g.conv_id == conv] == fixed and [g.position for g in got if g.conv_id == conv] == list(range(len(fixed)))
