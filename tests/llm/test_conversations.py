"""Conversation repair against the SQL twin, plain enumeration, and whole solutions of conversations in many pieces."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

import oracle
from palimpsest.llm import conversations as C
from palimpsest.llm import queries

ROWS = "conv_id long, turn long, role string, text string"
ROLES, TEXTS = ["user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", " \n", "Why?", "x! ", None]


def _faults(rows):
    out, seen = [], set()
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _plain(rows):
    """(cost, letters, text) by trying all edits, with up to two inserted rows at any place."""
    wrong, best = _faults(rows), None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, wrong)):
            continue
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, wrong))
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost = base + 2 * sum(gaps)
            letters = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            if best and (cost, letters) >= best[:2]:
                continue
            names, at = [], 0
            for letter in letters:
                held = rows[at] if letter != "I" else (None, "")
                at += letter != "I"
                if letter != "D":
                    names.append((letter, held))
            start = 1 if names and names[0][0] == "K" and names[0][1][0][:1] == "s" else 0
            want = ["system"] * start + [("user", "assistant")[k % 2] for k in range(len(names) - start)]
            if (len(names) - start) % 2 or start and len(names) == 1:
                continue
            if all(x != "K" or held[0][:1] == w[0] for (x, held), w in zip(names, want)):
                text = "\n".join(f"{held[0] if x == 'K' else w}:{held[1]}" for (x, held), w in zip(names, want))
                best = cost, letters, text
    return best


def _expected(conv, rows):
    """A result row from (turn, role, text) rows in any order."""
    own = sorted(((t, r or (" " if r is None else ""), " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    pairs = [r[1:] for r in own]
    wrong, turns = _faults(pairs), {t for t, _, _ in own if t is not None}
    illegal = sum((a[0][:1], b[0][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(pairs, pairs[1:]))
    cost, letters, text = _plain(pairs)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (conv, gaps, *(wrong.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())


def test_repair_matches_sql(spark, sf):
    oracle.compare(queries.op13_conversations(spark, sf), queries.ORACLE_SQL["op13_conversations"], sf)


def test_repair_matches_enumeration(spark):
    """Null ids, turns, roles and texts, repeats, ties of turns, clashing columns, one piece or a piece for each two rows."""
    rnd = random.Random(5)
    groups = {c: [(rnd.choice([None, 1, 2, 3, 7]), rnd.choice(ROLES[:3] * 3 + ROLES), rnd.choice(TEXTS)) for _ in range(rnd.randint(1, 5))] for c in [None, *range(40)]}
    rows = [(c, *r, "x", 1, 2.0) for c, own in groups.items() for r in own]
    df = spark.createDataFrame(rows, f"{ROWS}, part string, run int, found double").repartition(3)
    want = sorted((_expected(c, own) for c, own in groups.items()), key=str)
    for piece in (4096, 2):
        assert sorted(map(tuple, C.repair(df, piece=piece).collect()), key=str) == want
    turns = C.repaired_turns(df, piece=2).orderBy("part", "run", "place").collect()
    for c, *_, sha in want:
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns if r.conv_id == c).encode()).hexdigest() == sha


def test_long_conversation_in_many_pieces_is_solved_as_one(spark):
    rnd = random.Random(9)
    roles, texts = rnd.choices(["user", "assistant", "system", "uncle"], k=1500), [rnd.choice(["Yes.", "no", "", f"word {k}.", f"w {k}"]) for k in range(1500)]
    rows = [(1, k, r, t) for k, (r, t) in enumerate(zip(roles, texts))] + [(0, 1, "user", "a."), (2, 1, "user", "b.")]
    wrong = C.faults(roles, texts, [])
    cost, letters = C.least(roles, wrong, C.ENDS)[C.NOTHING]
    text = C._written(C.rewritten(roles, texts, C.NOTHING, letters))
    got = {r.conv_id: r for r in C.repair(spark.createDataFrame(rows, ROWS), piece=40).collect()}
    assert got[1].cost == cost and got[1].audit == letters and got[1].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert [got[1][k] for k in ("gaps", "blank", "duplicate", "truncated")] == [0, *(wrong.count(k) for k in ("blank", "duplicate", "truncated"))]
    assert (got[0].cost, got[0].audit) == (2, "KI") == (got[2].cost, got[2].audit)


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2, 3) for t in (None, *range(30)) for r, x in (("assistant", "a. b! c?"), (None, None))]
    got = {}
    for r in C.damage(spark.createDataFrame(rows, ROWS)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.gone))
    for c, t in {r[:2] for r in rows}:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = []
        for role, text in (("assistant", "a. b! c?"), (" ", " ")):
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            want += [("user" if h == 4 else role, text, h == 0)] * (1 + (h == 3))
        assert sorted(got[c, t]) == sorted(want)


def test_conversations_that_lose_all_rows_and_empty_tables(spark):
    gone = spark.createDataFrame([(4, 1, "user", "a", True), (5, None, None, None, True), (5, 2, "user", "b.", False)], f"{ROWS}, gone boolean")
    got = {r.conv_id: tuple(r)[1:8] for r in C.repair(gone, gone="gone").collect()}
    assert got == {4: (0, 0, 0, 0, 0, 0, ""), 5: (0, 0, 0, 0, 0, 2, "KI")}
    assert C.repair(gone.limit(0), gone="gone").count() == C.repaired_turns(gone.limit(0)).count() == 0


@pytest.mark.parametrize("ends", [(0,), (1,), (2,), (3,), (0, 3)])
def test_joined_pieces_are_least(ends):
    """The least path over all rows is the least of joined least paths, wherever the rows are cut."""
    rnd = random.Random(2)
    for _ in range(60):
        n = rnd.randint(0, 9)
        roles, wrong = rnd.choices(["user", "assistant", "system", "t"], k=n), rnd.choices(["", "", "truncated", "blank"], k=n)
        whole, at = C.least(roles, wrong, ends), rnd.randint(0, n)
        for q in range(4):
            both = [
                (a[0] + b[0], a[1] + b[1])
                for mid in range(4)
                if (a := C.least(roles[:at], wrong[:at], (mid,))[q]) and (b := C.least(roles[at:], wrong[at:], ends)[mid])
            ]
            assert min(both, default=None) == whole[q]
