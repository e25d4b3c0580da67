"""Minimal edit plans, whose phrases are unique in the old text, and the replay of plans that may be imperfect.

A plan is an array of tokens and markers. Each step of these algorithms depends on the last, inside one text; they run
as Arrow functions over the token arrays and the opcode table's rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import EDIT_TOKENS
from palimpsest.operators.edits import code_edit_plan, edit_opcodes

#: Marker stem of an opcode whose phrase took in kept tokens, by mode and opcode.
STEMS = {"comment": {"delete": "REPLACE_{}_DELETE", "replace": "REPLACE_{}", "insert": "INSERT_{}"}, "other": dict.fromkeys(("delete", "replace", "insert"), "REPLACE_{}")}
MARKS = frozenset(EDIT_TOKENS)


class Places:
    """Where phrases of a token list occur in it."""

    def __init__(self, words: list[str]):
        self.words = words
        self.at: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.at.setdefault(w, []).append(i)

    def from_(self, word: str, start: int) -> list[int]:
        """A word's places from a place on."""
        at = self.at.get(word, [])
        return at[bisect_left(at, start) :]

    def of(self, phrase: list[str], start: int = 0) -> list[int]:
        return [i for i in self.from_(phrase[0], start) if self.words[i : i + len(phrase)] == phrase] if phrase else []

    def agree(self, phrase: list[str], skipped: int, at: int) -> int:
        """How many tokens of the phrase, from one on, stand from a place on."""
        n = 0
        while skipped + n < len(phrase) and at + n < len(self.words) and self.words[at + n] == phrase[skipped + n]:
            n += 1
        return n

    def widths(self, lo: int, hi: int, bound: int) -> int | None:
        """How far old[lo:hi] must grow towards the bound, in its direction, until it occurs once; None if it never does."""
        left = bound < lo
        step = 1
        while step <= (lo - bound if left else bound - hi):
            if len(self.of(self.words[lo - step : hi] if left else self.words[lo : hi + step])) == 1:
                return step
            step += 1
        return None


def minimal_plan(ops, old: list[str], new: list[str], mode: str) -> list[str]:
    """Markers and tokens of all changes; an ambiguous phrase grows into the kept run before it, or else behind it, and
    what one change takes from a run the next cannot take. Without a way for one change, one replacement of all."""
    places = Places(old)
    stems = STEMS[mode]
    plan: list[str] = []
    free = 0  # kept tokens before this place belong to earlier changes
    for k, op in enumerate(ops):
        tag, lo, hi, start, end = op["tag"], op["o_start"], op["o_end"], op["n_start"], op["n_end"]
        if tag == "equal":
            continue
        gone, come = old[lo:hi], new[start:end]
        if tag != "insert" and len(places.of(gone)) == 1:
            plan += ["<DELETE>", *gone, "<DELETE_END>"] if tag == "delete" else ["<REPLACE_OLD>", *gone, "<REPLACE_NEW>", *come, "<REPLACE_END>"]
            continue
        before = max(free, ops[k - 1]["o_start"]) if k and ops[k - 1]["tag"] == "equal" else lo
        behind = ops[k + 1]["o_end"] if k + 1 < len(ops) and ops[k + 1]["tag"] == "equal" else hi
        if before < lo and (n := places.widths(lo, hi, before)):
            side, olds, news = "BEFORE", old[lo - n : hi], old[lo - n : lo] + come
        elif behind > hi and (n := places.widths(lo, hi, behind)):
            side, olds, news, free = "AFTER", old[lo : hi + n], come + old[hi : hi + n], hi + n
        else:
            return ["<REPLACE_OLD>", *old, "<REPLACE_NEW>", *new, "<REPLACE_END>"]
        first, second = (f"<{stems[tag].format(x)}{'_KEEP_' + side if mode == 'comment' else ''}>" for x in ("OLD", "NEW"))
        plan += [first, *olds, second, *news, "<INSERT_END>" if stems[tag].startswith("INSERT") else "<REPLACE_END>"]
    return plan


def minimal_edit_plan(ops: Column, old: Column, new: Column, mode: str = "other") -> Column:
    """The plan of changes only, every phrase unique in the old text. mode "comment" tells by its markers which side a
    phrase grew to. Equal texts have an empty plan; a null side gives null."""
    if mode not in STEMS:
        raise ValueError(mode)

    @F.pandas_udf("array<string>")
    def column(opcodes: pd.Series, olds: pd.Series, news: pd.Series) -> pd.Series:
        rows = zip(opcodes, olds, news, strict=True)
        return pd.Series([None if o is None or a is None or b is None else minimal_plan(list(o), list(a), list(b), mode) for o, a, b in rows])

    return column(ops, old, new)


def edit_plan(mode: str, old: Column, new: Column) -> Column:
    """The plan of a mode: "code" marks kept runs too, "comment" and every other mode are minimal."""
    ops = edit_opcodes(old, new)
    if mode == "code":
        return code_edit_plan(ops, old, new)
    return minimal_edit_plan(ops, old, new, "comment" if mode == "comment" else "other")


def edit_token_labels(ops: Column, old: Column, new: Column) -> Column:
    """Marker and token in turn: kept, deleted and replaced old tokens, inserted and new ones."""
    def one(op: Column) -> Column:
        o, n = F.slice(old, op["o_start"] + 1, op["o_end"] - op["o_start"]), F.slice(new, op["n_start"] + 1, op["n_end"] - op["n_start"])
        both = lambda words, mark: F.flatten(F.transform(words, lambda t: F.array(F.lit(mark), t)))
        return (
            F.when(op["tag"] == "equal", both(o, "<KEEP>")).when(op["tag"] == "delete", both(o, "<DELETE>"))
            .when(op["tag"] == "insert", both(n, "<INSERT>")).otherwise(F.concat(both(o, "<REPLACE_OLD>"), both(n, "<REPLACE_NEW>")))
        )

    return F.flatten(F.transform(ops, one))


class Step(NamedTuple):
    """One step of a plan: its first marker, the token runs behind its markers, and where the last run begins."""

    kind: str
    runs: list[list[str]]
    start: int


#: What closes each run of a step, by the step's first marker: in code plans, and in minimal ones.
CODE_STEPS = {
    "<KEEP>": [{"<KEEP_END>"}], "<DELETE>": [{"<DELETE_END>"}], "<INSERT>": [{"<INSERT_END>"}], "<REPLACE_OLD>": [{"<REPLACE_NEW>"}, {"<REPLACE_END>"}],
}
MINIMAL_STEPS = {"<DELETE>": [{"<DELETE_END>"}]} | {
    m: [{x for x in MARKS if stem in x and "NEW" in x}, {f"<{stem}_END>"}] for stem in ("INSERT", "REPLACE") for m in MARKS if m.startswith(f"<{stem}_OLD")
}


def steps(plan: list[str], kinds: dict[str, list[set[str]]]) -> Iterator[Step]:
    """The steps of a plan in order; a run that nothing closes goes to the end, tokens between steps are passed over."""
    i = 0
    while i < len(plan):
        kind, i = plan[i], i + 1
        if kind in kinds:
            runs, start = [], i
            for closers in kinds[kind]:
                start = i
                stop = next((k for k in range(i, len(plan)) if plan[k] in closers), len(plan))
                runs.append(plan[start:stop])
                i = stop + 1
            yield Step(kind, runs, start)


def rebuilt(old: list[str], gone: set[int], new: dict[int, list[str]]) -> list[str]:
    """The old words without those that go, with the new ones before their places."""
    return [w for i in range(len(old) + 1) for w in [*new.get(i, []), *([old[i]] if i < len(old) and i not in gone else [])]]


def code_anchors(old: list[str], plan: list[str]) -> tuple[set[int], dict[int, list[str]]]:
    """(places that go, new tokens before places) of a code plan on the old text.

    The old words before a frontier are done. A kept run moves it as far as its words stand there; a dropped word goes
    where it stands next, the word just before the frontier included; new words are anchored at the next place of the word
    that the plan keeps after them, or at the end if it keeps none.
    """
    places, gone, new, at = Places(old), set(), {}, 0
    parsed = list(steps(plan, CODE_STEPS))
    # What the plan keeps next, for each step: also a run that is cut off or stands between steps counts.
    keeps = [i for i, w in enumerate(plan) if w == "<KEEP>"]
    for kind, runs, start in parsed:
        if kind == "<KEEP>":
            for w in runs[0]:
                at += at < len(old) and at not in gone and old[at] == w
            continue
        if kind != "<INSERT>":
            for w in runs[0]:
                spot = next((i for i in places.from_(w, at - 1) if i not in gone), None)
                at = min(at, len(old) - 1) + 1 if spot is None else spot + 1
                gone |= {spot} - {None}
        if kind != "<DELETE>":
            nth = bisect_left(keeps, start)
            after = plan[keeps[nth] + 1] if nth < len(keeps) and keeps[nth] + 1 < len(plan) else None
            spot = len(old) if after is None else next((i for i in places.from_(after, at) if i not in gone), at)
            new.setdefault(spot, []).extend(runs[-1])
            at = spot
    return gone, new


def code_whole(old: list[str], plan: list[str]) -> list[str] | None:
    """The new words of a code plan that names every old word in its place: its runs say all, so nothing is looked for, and
    words that repeat cannot be taken for each other. None for a plan that leaves old words out or has others."""
    at, new = 0, []
    for kind, runs, _ in steps(plan, CODE_STEPS):
        if kind != "<INSERT>":
            if old[at : at + len(runs[0])] != runs[0]:
                return None
            at += len(runs[0])
        if kind != "<DELETE>":
            new += runs[-1]
    return new if at == len(old) else None


def replay_code(old: list[str], plan: list[str]) -> str:
    """The new text of a code plan, by its runs if it names all of the old text, else by anchors. Empty if a marker is left
    in the result."""
    words = code_whole(old, plan)
    text = " ".join(rebuilt(old, *code_anchors(old, plan)) if words is None else words)
    return "" if any(m in text for m in MARKS) else text


def locate_longest(phrase: list[str], places: Places, start: int) -> tuple[int, int, bool] | None:
    """(place, tokens left out before it, whether it is ambiguous) of the phrase's first longest part that occurs: it
    begins at the first token with a place, since a longer part would need one too."""
    skipped = next((i for i, w in enumerate(phrase) if places.from_(w, start)), None)
    if skipped is None:
        return None
    runs = [(places.agree(phrase, skipped, at), at) for at in places.from_(phrase[skipped], start)]
    most = max(n for n, _ in runs)
    own = [at for n, at in runs if n == most]
    return own[0], skipped, len(own) > 1


def anchored(old: list[str], plan: list[str]) -> tuple[set[int], dict[int, list[str]], list[tuple[list[str], list[str] | None]]]:
    """(places that go, new tokens before places, ambiguous steps) of a minimal plan on the old text.

    Each step is anchored behind the one before: by the longest part of its old phrase, whose other tokens are looked
    for before it, singly, or behind it, in order. A step without an anchor has no effect.
    """
    places, gone, new, again, at = Places(old), set(), {}, [], 0
    for _, runs, _ in steps(plan, MINIMAL_STEPS):
        phrase, fresh = runs[0], runs[1] if len(runs) > 1 else None
        spot = locate_longest(phrase, places, at)
        if spot is None:
            continue
        place, skipped, several = spot
        missed = Counter(phrase[:skipped])
        for i in range(at, place):
            if missed[old[i]] > 0:
                missed[old[i]] -= 1
                gone.add(i)
        at = place
        for w in phrase[skipped:]:
            if found := places.of([w], at):
                gone.add(found[0])
                at = found[0] + 1
        new.setdefault(at, []).extend(fresh or [])
        if several:
            again.append((phrase, fresh))
    return gone, new, again


def replay_minimal(old: list[str], plan: list[str]) -> str:
    """The new text of a minimal plan: the old one rebuilt from its anchored steps. Phrases that had several places are
    then deleted, and after that replaced, wherever they are left and their new tokens do not stand there already."""
    gone, new, again = anchored(old, plan)
    out = rebuilt(old, gone, new)
    left = Places(out)
    cut = {i for phrase, fresh in again if fresh is None for s in left.of(phrase) for i in range(s, s + len(phrase))}
    out = [w for i, w in enumerate(out) if i not in cut]
    for phrase, fresh in again:
        for s in reversed(Places(out).of(phrase)) if fresh is not None else ():
            if out[s : s + len(fresh)] != fresh or s + len(fresh) >= len(out):
                out[s : s + len(phrase)] = fresh
    return " ".join(out)


def apply_edit_plan(mode: str, old: Column, plan: Column) -> Column:
    """The text that a plan makes of the old tokens; null for modes other than "code", "comment" and "minimal"."""
    one = {"code": replay_code, "comment": replay_minimal, "minimal": replay_minimal}.get(mode)
    if one is None:
        return F.lit(None).cast("string")

    @F.pandas_udf("string")
    def column(olds: pd.Series, plans: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or p is None else one(list(a), list(p)) for a, p in zip(olds, plans, strict=True)], dtype=object)

    return column(old, plan)
