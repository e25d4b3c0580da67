"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

A conversation may hold one system row and must then alternate user and assistant, ending on assistant, or be empty. Rows
are kept, given another role, deleted, or empty ones inserted. Edits are found on the graph of (row, what was written
last) whose arcs are edits. A path's weight is one whole number: its high digits are the cost, its low digits, of a fixed
width, are the letters of its edits from the left with zeros after the end. So the least number is the cheapest path and,
among those, the one whose letters come first; an ordinary dynamic program over integers decides everything.

Rows are ordered by a range partitioning, which also parts a conversation that is longer than a partition. Those that lie
within a partition are solved where they stand. The others, at most two for each partition and all very long ones, are
solved piece by piece: each piece gives the least weight from each state to each state, and a stream over a
conversation's pieces joins them. Of two paths over the same rows that cost the same none is the beginning of the
other, since only inserted rows could follow, so joining least pieces gives the least whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.llm.common import cut

#: Rows, and bytes of text, of one piece of a long conversation.
PIECE, PIECE_BYTES = 4096, 4 << 20
#: Characters of a text that take part in dealing rows out; the whole text decides the order.
PREFIX = 64

#: What was written last: nothing, system, user, assistant. A conversation may end on nothing or on assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: The state after the role that has to come next, and that role's name.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: Letters of delete, insert, keep and re-role as octal digits, in ASCII order; zero is the end.
LETTERS = " DIKR"
RETAIN, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1

_BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
_ENDED = re.compile(r"[.!?]\Z").search
LINES = "array<struct<role string, text string>>"
FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Harms rows by the remainder h of crc32("conv:turn") by 20 and adds ``gone``: 0 marks the row gone, 1 empties the
    text, 2 takes its marks ``.!?``, 3 repeats the row, 4 makes it the user's. Nulls count as one space, but a null turn
    stays null for the order. Gone rows stay in the table, so that no conversation is forgotten. Other columns go."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space(conv), F.lit(":"), space(turn)).cast("binary")) % 20
    harmed = F.when(h == 1, "").when(h == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    return rows.select(
        F.col(conv), F.col(turn), F.when(h == 4, "user").otherwise(space(role)).alias(role), harmed.alias(text), (h == 0).alias("gone"),
        F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _after(state: int, initial: str) -> int | None:
    """The state after a row of this initial is kept, if it may be."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def faults(roles: list[str], texts: list[str], seen: list[int]) -> list[str]:
    """Each row's first fault: blank, duplicate, truncated or none. seen: places of rows that stood earlier elsewhere."""
    own, before, out = set(seen), {}, []
    for at, row in enumerate(zip(roles, texts, strict=True)):
        first = before.setdefault(row, at)
        body = row[1].rstrip(_BLANK)
        out.append("blank" if not body else "duplicate" if first < at or at in own else "" if _ENDED(body) else "truncated")
    return out


def least(roles: list[str], wrong: list[str], ends: tuple[int, ...]) -> list[tuple[int, str] | None]:
    """(cost, letters) of the least path from each state before the rows to one of the ends after them."""
    n = len(roles)
    width = 3 * n + 2  # two inserted rows at each of n + 1 places, since a third would undo the first
    low, top = 3 * width, 3 * width - 3
    mask = (1 << low) - 1

    def put(letter: int, cost: int, rest: int | None) -> int | None:
        return None if rest is None else ((rest >> low) + cost << low) + (letter << top) + ((rest & mask) >> 3)

    def smallest(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    def with_inserts(taken: list[int | None]) -> list[int | None]:
        once = [put(2, INSERT, taken[NEXT[q]]) for q in range(4)]
        return [smallest(taken[q], once[q], put(2, INSERT, once[NEXT[q]])) for q in range(4)]

    paths = with_inserts([0 if q in ends else None for q in range(4)])
    for role, fault in zip(reversed(roles), reversed(wrong), strict=True):
        more, taken = CUT_SHORT * (fault == "truncated"), []
        for q in range(4):
            weight = put(1, DELETE, paths[q])
            if fault not in ("blank", "duplicate"):
                kept = _after(q, role[:1])
                weight = smallest(weight, None if kept is None else put(3, RETAIN + more, paths[kept]), put(4, REROLE + more, paths[NEXT[q]]))
            taken.append(weight)
        paths = with_inserts(taken)
    read = lambda w: f"{w & mask:0{width}o}".rstrip("0").translate(str.maketrans("1234", LETTERS[1:]))
    return [None if w is None else (w >> low, read(w)) for w in paths]


def rewritten(roles: list[str], texts: list[str], state: int, letters: str) -> list[dict]:
    """The rows that the edits leave, from a state on."""
    out, at = [], 0
    for letter in letters:
        if letter != "D":
            state = _after(state, roles[at][:1]) if letter == "K" else NEXT[state]
            out.append({"role": roles[at] if letter == "K" else NAME[state], "text": "" if letter == "I" else texts[at]})
        at += letter != "I"
    return out


def _figures(turns: list[int | None], roles: list[str], wrong: list[str]) -> dict:
    """Counts of a piece, and what its neighbours need: its outer turns and initials."""
    known = [t for t in turns if t is not None]
    initials = [r[:1] for r in roles]
    pairs = sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in zip(initials, initials[1:]))
    ends = {"low": known[0], "high": known[-1]} if known else {"low": None, "high": None}
    edges = {"first": initials[0], "last": initials[-1]} if roles else {"first": None, "last": None}
    return {k: wrong.count(k) for k in COUNTS} | {"illegal": pairs, "turns": len(set(known))} | ends | edges


def _added(a: dict | None, b: dict) -> dict:
    """The figures of two pieces in a row."""
    if a is None:
        return b
    out = {k: a[k] + b[k] for k in (*COUNTS, "illegal", "turns")}
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["illegal"] += None not in (a["last"], b["first"]) and (a["last"], b["first"]) not in (("s", "u"), ("u", "a"), ("a", "u"))
    for k, p, q in (("low", a, b), ("first", a, b), ("high", b, a), ("last", b, a)):
        out[k] = q[k] if p[k] is None else p[k]
    return out


def _summary(figures: dict, cost: int, audit: str, sha: str) -> dict:
    gaps = 0 if figures["low"] is None else figures["high"] - figures["low"] + 1 - figures["turns"]
    return {"gaps": gaps} | {k: figures[k] for k in (*COUNTS, "illegal")} | {"cost": cost, "audit": audit, "repaired_sha256": sha}


def _written(lines: list[dict]) -> str:
    return "\n".join(f"{x['role']}:{x['text']}" for x in lines)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == most:
            yield made()
            held = []
    yield made()


def _mapped(df: DataFrame, work, schema: str | StructType) -> DataFrame:
    """mapInArrow for a function of plain rows."""
    kind = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kind)
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), arrow), kind)


def _pieces(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """Sorted rows to pieces of one conversation, of so many rows at most: (conv, part, run, whole, turns, roles, texts)."""
    part = TaskContext.get().partitionId()
    run, first, own, size, pieces = 0, True, [], 0, []
    now: object = _pieces  # no conversation is this

    def closed(last: bool) -> Iterator[tuple]:
        nonlocal run
        whole = not first and not last and len(pieces) == 1
        for turns, roles, texts in pieces:
            yield now, part, run, whole, turns, roles, texts
            run += 1

    def pack() -> None:
        nonlocal own, size
        pieces.append(tuple(list(c) for c in zip(*own, strict=True)) if own else ([], [], []))
        own, size = [], 0

    for conv, turn, role, text, gone in rows:
        if now is _pieces or conv != now:
            if now is not _pieces:
                if own or not pieces:
                    pack()
                yield from closed(False)
                first, pieces = False, []
            now = conv
        if not gone:
            if len(own) >= most or size >= PIECE_BYTES:
                pack()
                if len(pieces) > 1:  # of a long conversation, what is packed can go
                    yield from ((now, part, run + k, False, *p) for k, p in enumerate(pieces[:-1]))
                    run, pieces, first = run + len(pieces) - 1, pieces[-1:], True
            own.append((turn, role, text))
            size += len(text)
    if now is not _pieces:
        if own or not pieces:
            pack()
        yield from closed(True)


def _solved(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Whole conversations: (conv, part, run, lines, found)."""
    for conv, part, run, _, turns, roles, texts in rows:
        wrong = faults(roles, texts, [])
        cost, audit = least(roles, wrong, ENDS)[NOTHING]
        lines = rewritten(roles, texts, NOTHING, audit)
        sha = hashlib.sha256(_written(lines).encode()).hexdigest()
        yield conv, part, run, lines, _summary(_figures(turns, roles, wrong), cost, audit, sha)


def _weighed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Pieces of open conversations: (conv, part, run, paths from state to state, figures)."""
    for conv, part, run, turns, roles, texts, seen in rows:
        wrong = faults(roles, texts, seen or [])
        paths = [
            {"start": q, "end": end, "cost": p[0], "letters": p[1]}
            for end in range(4) for q, p in enumerate(least(roles, wrong, (end,))) if p is not None
        ]
        yield conv, part, run, paths, _figures(turns, roles, wrong)


def _joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Weighed pieces in order to each piece's own letters: (part, run, state, letters, figures and cost at the last)."""
    held: list[tuple] = []  # (part, run)
    now: object = _joined
    figures, settled, live = None, [], {}

    def ended() -> Iterator[tuple]:
        cost, tail, sizes, states = min(live[q] for q in ENDS if q in live)
        audit, at = "".join(settled) + tail, 0
        for k, ((part, run), size, state) in enumerate(zip(held, sizes, states, strict=True)):
            last = k + 1 == len(held)
            yield part, run, state, audit[at : at + size], _summary(figures, cost, audit, "") if last else None
            at += size

    for conv, part, run, paths, own in rows:
        if now is _joined or conv != now:
            if now is not _joined:
                yield from ended()
            now, held, figures, settled, live = conv, [], None, [], {NOTHING: (0, "", [], [])}
        held.append((part, run))
        figures = _added(figures, own)
        after: dict[int, tuple] = {}
        for p in paths:
            if p["start"] in live:
                cost, tail, sizes, states = live[p["start"]]
                new = (cost + p["cost"], tail + p["letters"], p["start"], len(p["letters"]))
                if p["end"] not in after or new[:2] < after[p["end"]][:2]:
                    after[p["end"]] = new
        common = os.path.commonprefix([x[1] for x in after.values()])
        settled.append(common)
        live = {q: (c, t[len(common) :], [*live[s][2], n], [*live[s][3], s]) for q, (c, t, s, n) in after.items()}
    if now is not _joined:
        yield from ended()


def _hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Edited pieces in order to (conv, part, run, lines, found); the last piece of a conversation has what was found."""
    sha, begun = hashlib.sha256(), False
    for conv, part, run, roles, texts, state, letters, found in rows:
        lines = rewritten(roles, texts, state, letters)
        if lines:
            sha.update(("\n" * begun + _written(lines)).encode())
            begun = True
        if found is not None:
            found = found | {"repaired_sha256": sha.hexdigest()}
            sha, begun = hashlib.sha256(), False
        yield conv, part, run, lines, found


def _repaired(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None, piece: int) -> DataFrame:
    """Pieces of repaired conversations: (conv, part, run, lines, found)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    away = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    plain = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), away.alias("gone"))
    order: list[Column] = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = plain.repartitionByRange(*order, F.substring("text", 1, PREFIX)).sortWithinPartitions(*order, "text")
    kind = plain.schema["conv"].dataType.simpleString()
    id_ = f"conv {kind}, part long, run long"
    solved = f"{id_}, lines {LINES}, found struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"
    pieces = cut(_mapped(dealt, partial(_pieces, most=piece), f"{id_}, whole boolean, turns array<long>, roles array<string>, texts array<string>"))
    whole = _mapped(pieces.where("whole"), _solved, solved)

    # Rows of open conversations that stood in an earlier piece. A row's first place in a piece speaks for its repeats.
    open_ = pieces.where(~F.col("whole")).drop("whole")
    each = open_.select("conv", "part", "run", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row"))
    firsts = each.groupBy("conv", "part", "run", "row").agg(F.min("at").alias("at"))
    place = F.struct("part", "run")
    seen = firsts.withColumn("first", F.min(place).over(Window.partitionBy("conv", "row"))).where(place > F.col("first"))
    seen = seen.groupBy("part", "run").agg(F.collect_list("at").alias("seen"))
    figures = "struct<blank:long,duplicate:long,truncated:long,illegal:long,turns:long,low:long,high:long,first:string,last:string>"
    paths = "array<struct<start:int,end:int,cost:long,letters:string>>"
    weighed = _mapped(open_.join(seen, ["part", "run"], "left").select("conv", "part", "run", "turns", "roles", "texts", "seen"), _weighed, f"{id_}, paths {paths}, figures {figures}")
    joined = _mapped(weighed.repartition("conv").sortWithinPartitions("conv", "part", "run"), _joined, f"part long, run long, state int, letters string, found struct<{FOUND.replace(' ', ':').replace(',:', ',')}>")
    edited = open_.join(joined, ["part", "run"]).select("conv", "part", "run", "roles", "texts", "state", "letters", "found")
    return whole.unionAll(_mapped(edited.repartition("conv").sortWithinPartitions("conv", "part", "run"), _hashed, solved))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, piece: int = PIECE) -> DataFrame:
    """One row for each conversation: its faults, the cheapest edits and a digest of what they leave.

    Rows are taken by turn, null first, then role and text in byte order; rows that are equal in all three are repeats
    of each other. Null roles and texts count as one space, a null id is a conversation of its own, rows marked by the
    boolean column ``gone`` only make their conversation known. gaps counts missing turns between the least and the
    largest, blank, duplicate and truncated each row's first fault, illegal the neighbours whose initials are not su, ua
    or au. A conversation without rows has zeros, no letters and the digest of an empty string. An empty table gives an
    empty one; texts are whole; other columns, of any name, are not looked at. The letters of a conversation are one
    string, and its digest is made by one stream over its pieces: both are what is asked for.
    """
    return _repaired(rows, conv, turn, role, text, gone, piece).where("found is not null").select(F.col("conv").alias(conv), "found.*")


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None, piece: int = PIECE) -> DataFrame:
    """The rows of the repaired conversations: id, role, text and the columns part, run and place, by which a
    conversation's rows are in order. What ``repair`` says of nulls, repeats and empty tables holds."""
    own = _repaired(rows, conv, turn, role, text, gone, piece)
    lines = own.select("conv", "part", "run", F.posexplode("lines").alias("place", "line"))
    return lines.select(F.col("conv").alias(conv), "part", "run", "place", F.col("line.role").alias(role), F.col("line.text").alias(text))
