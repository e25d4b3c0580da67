"""Personal data in text, plain and disguised, with spans in the source's code points.

Plain identifiers are found by fixed patterns. Disguised ones are found by three small transducers that rewrite a text
while they keep, for each character they put out, the source range it stands for: (1) look-alike characters become
ASCII, invisible ones go, and in numbers letters that look like digits become digits, (2) written digits become digits and the blanks between them go, (3) "[at]", "(dot)" and
bare "dot" between name parts become "@" and ".", and so do dots between digits and "plus" before them. The plain
patterns then run over the rewritten text, and what they find there, if it rests on a rewritten part, is mapped back.
Commas, slashes and line ends between written digits are read as bounds of numbers first, and as gaps in one number
where that finds nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PART_CHARS = _LOCAL_CHARS - {"."}
# A match can start inside a run of digits only where one starts at the run's head, so the look-behinds lose nothing
# and keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """At each @ the longest run of name characters before it, then a dotted domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            end = free = m.end()
            yield "email", start, end
        else:
            free = end
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Plain identifiers by start, then kind in the order of KINDS."""
    found = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Letters of other scripts that look like ASCII letters and signs, the signs of one kind together.
_LETTERS_ALIKE = dict(zip("АВЕКМНОРСТУХЅІЈаеорсухѕіјԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυχιɑɡıℓ", "ABEKMHOPCTYXSIJaeopcyxsijdhqwABEZHIKMNOPTYXavopuxiagil", strict=True))
_SIGNS_ALIKE = {".": "․‧。∙•·﹒", "@": "＠﹫", "+": "﹢⁺", "-": "‐‑‒–—−"}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _plain_forms() -> dict[str, str]:
    """For each character with an ASCII form what that form is: looks first, then compatibility, then digits' values."""
    forms = dict.fromkeys(_INVISIBLE, "") | _LETTERS_ALIKE | {c: sign for sign, alike in _SIGNS_ALIKE.items() for c in alike}
    # The planes beyond the first two hold ideographs and the like, which have none.
    for c in map(chr, range(0x80, 0x20000)):
        if c not in forms and not 0xD800 <= ord(c) < 0xE000:
            put = "".join(_LETTERS_ALIKE.get(x, x) for x in unicodedata.normalize("NFKC", c))
            put = put if put.isascii() else str(unicodedata.decimal(c, ""))
            if put and put != c:
                forms[c] = put
    return forms


_PLAIN_FORM = _plain_forms()

# The names of the digits in English, German, French and Spanish.
_DIGIT_NAMES = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6",
    "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_NAME = "|".join(sorted(_DIGIT_NAMES, key=len, reverse=True))
_POINT = r"dot|point|punkt|punto"
# A name ends where its letters do; digits may stand right beside it.
_NAMED = rf"(?<![^\W\d_])(?:{_NAME})(?![^\W\d_])"
_DIGIT = rf"(?:{_NAMED}|[0-9])"
_SEP = r"[ \t\n,/-]{1,3}"
_AT_WORD = r"at|arroba|klammeraffe|arobase"
# Blanks before a sign count from their run's head, so that long runs stay linear.
_GAP = r"(?<![ \t])[ \t]+"
_AT = rf"(?:{_GAP})?[\[({{<][ \t]*(?:{_AT_WORD}|@)[ \t]*[\])}}>][ \t]*|{_GAP}@[ \t]+|(?:{_GAP})?_at_[ \t]*"
_DOT = rf"(?:{_GAP})?[\[({{<][ \t]*(?:{_POINT}|\.)[ \t]*[\])}}>][ \t]*|{_GAP}(?:{_POINT})[ \t]+|_dot_"
# Written digits in a row: at least one name, two digits or more in all.
_NUMBER = re.compile(rf"(?:(?:\bplus\b|\+)[ \t]?)?{_DIGIT}(?:(?:{_SEP}|{_DOT}|\.)?{_DIGIT})+", re.IGNORECASE)
_NAMES_NEAR = re.compile(
    rf"{_NAMED}(?:(?:{_SEP}|{_DOT}|\.){_DIGIT}|[0-9])|[0-9](?:{_SEP}|{_DOT}|\.)?{_NAMED}", re.IGNORECASE
)
_PIECE = re.compile(rf"(?P<name>{_NAMED})|(?P<digit>[0-9])|(?P<plus>\bplus\b|\+)|(?P<dot>{_DOT})|(?P<sep>.)", re.IGNORECASE | re.DOTALL)
_HAS_NAME = re.compile(_NAMED, re.IGNORECASE).search
_BOUNDS = frozenset("\n,/")
# Letters that are written for digits.
_DIGITS_ALIKE = {"l": "1", "I": "1", "O": "0", "o": "0"}
# Ten digits or letters for them at least, or four parts with points, not inside a word.
_LOOKS_LIKE_NUMBER = re.compile(
    r"(?<![A-Za-z0-9])(?:[0-9lIOo]{1,3}(?:\.[0-9lIOo]{1,3}){3}|[0-9lIOo](?:[ ().-]{0,2}[0-9lIOo]){9,})(?![A-Za-z0-9])"
)
_GLUED = re.compile(r"[0-9][^\W\d_]|[^\W\d_][0-9]").search
_DOTTED = re.compile(rf"(?<=[0-9])(?:{_DOT})(?=[0-9])", re.IGNORECASE)
_PLUS = re.compile(r"(?:\bplus\b[ \t]?|[\[({<][ \t]*(?:plus|\+)[ \t]*[\])}>][ \t]*)(?=[0-9])", re.IGNORECASE)

_MARK = re.compile(rf"{_AT}|{_DOT}", re.IGNORECASE)
_BARE_AT = re.compile(rf"[ \t]+(?:{_AT_WORD})[ \t]+|_at_", re.IGNORECASE)
_DOTS = re.compile(_DOT, re.IGNORECASE)
_AT_SIGN = re.compile(rf"{_AT}|{_GAP}(?:{_AT_WORD})[ \t]+|@", re.IGNORECASE)
_DOT_SIGN = re.compile(rf"{_DOT}|\.", re.IGNORECASE)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.IGNORECASE)


class Rewritten:
    """A text with, for each character, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def replace(self, changes: list[tuple[int, int, str]]) -> None:
        """Puts, for each (from, to, string) in order, the string in place of the range; "" removes it."""
        if not changes:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for lo, hi, put in [*changes, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:lo])
            start += self.start[at:lo]
            end += self.end[at:lo]
            new += self.new[at:lo]
            if put:
                text.append(put)
                start += [self.start[lo]] * len(put)
                end += [self.end[hi - 1]] * len(put)
                new += b"\1" * len(put)
            elif hi > lo and new:
                new[-1] = 1
            at = hi
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def _plain_letters(r: Rewritten) -> None:
    """Transducer 1: compatibility forms, look-alikes and digits of other scripts to ASCII, invisible characters to
    nothing; a character can stand for several."""
    if odd := sorted(_PLAIN_FORM.keys() & set(r.text)):
        r.replace([(m.start(), m.end(), _PLAIN_FORM[m[0]]) for m in re.finditer(f"[{re.escape(''.join(odd))}]", r.text)])


def _plain_numbers(r: Rewritten) -> None:
    """Transducer 1 in numbers: letters that stand for digits, where at least half of the signs are digits."""
    changes = []
    for m in _LOOKS_LIKE_NUMBER.finditer(r.text):
        alike = [i for i in range(*m.span()) if r.text[i] in _DIGITS_ALIKE]
        if alike and 2 * len(alike) <= sum(c.isalnum() for c in m[0]):
            changes += [(i, i + 1, _DIGITS_ALIKE[r.text[i]]) for i in alike]
    r.replace(changes)


def _plain_digits(r: Rewritten, fuse: bool) -> bool:
    """Transducer 2: digit names to digits, "plus" to +, "dot" between them to a point; blanks and hyphens between them
    go, commas, slashes and line ends too if ``fuse``. Returns whether any of the latter stayed."""
    changes, bounds = [], False
    for m in _NUMBER.finditer(r.text):
        if not _HAS_NAME(m[0]):
            continue
        inside = []
        for p in _PIECE.finditer(r.text, *m.span()):
            kind = p.lastgroup
            if kind == "name":
                inside.append((*p.span(), _DIGIT_NAMES[p[0].lower()]))
            elif kind == "plus" and p[0] != "+":
                inside.append((*p.span(), "+"))
            elif kind == "dot":
                inside.append((*p.span(), "."))
            elif kind == "sep" and p[0] in _BOUNDS and not fuse:
                bounds = True
            elif kind == "sep" and p[0] != ".":
                inside.append((*p.span(), ""))
        changes += inside
    r.replace(changes)
    return bounds


def _plain_points(r: Rewritten) -> None:
    """Transducer 3 between digits: disguised dots to points, then "plus" before digits to +."""
    r.replace([(*m.span(), ".") for m in _DOTTED.finditer(r.text)])
    r.replace([(*m.span(), "+") for m in _PLUS.finditer(r.text)])


def _plain_marks(r: Rewritten) -> None:
    """Transducer 3: disguised at signs and dots between name parts to the signs. At each sign with a host's name behind
    it, the parts before it are walked back over, so an address can be of any length."""
    changes, done, text = [], 0, r.text
    dots: dict[int, int] | None = None
    for m in _AT_SIGN.finditer(text):
        lo, hi = m.span()
        host = _HOST.match(text, hi) if lo >= done else None
        if host is None:
            continue
        hidden_host = [d.span() for d in _DOTS.finditer(text, *host.span())]
        # A bare "at" is a word like any other unless the dots behind it are disguised too.
        if _BARE_AT.fullmatch(m[0]) and not hidden_host:
            continue
        if dots is None:
            dots = {d.end(): d.start() for d in _DOT_SIGN.finditer(text)}
        hidden, at = [], _name_start(text, lo, done)
        if at == lo:
            continue
        while at in dots and (start := _name_start(text, dots[at], done)) < dots[at]:
            if text[dots[at] : at] != ".":
                hidden.append((dots[at], at))
            at = start
        if m[0] == "@" and not hidden and not hidden_host:
            continue
        changes += sorted([(s, e, ".") for s, e in hidden + hidden_host] + [(lo, hi, "@")] * (m[0] != "@"))
        done = host.end()
    r.replace(changes)


def _name_start(text: str, end: int, least: int) -> int:
    """Where the run of name signs before ``end`` begins, not before ``least``; "_at_" and "_dot_" end it."""
    at = end
    while at > least and text[at - 1] in _PART_CHARS:
        if text[at - 1] == "_" and text[max(0, at - 5) : at].lower().endswith(("_at_", "_dot_")):
            break
        at -= 1
    return at


_NAME_SET, _POINT_SET = frozenset(_DIGIT_NAMES), frozenset(_POINT.split("|"))
_BRACKETS = tuple(b + gap for b in "[({<" for gap in ("a", " a", "k", " k", "d", " d", "p", " p", "@", " @", ".", " ."))
_MARK_WORDS = (*_POINT_SET, " @", "_at_")


def _may_spell(low: str) -> bool:
    """Whether a digit's name stands next to a digit or another digit's name; a quick test before the patterns."""
    if _GLUED(low) and _NAMES_NEAR.search(low):
        return True
    for sign in ",/-+().[]{}<>":
        low = low.replace(sign, " ")
    words = low.split()
    if _NAME_SET.isdisjoint(words):
        return False
    for k, w in enumerate(words):
        if w in _NAME_SET:
            near = [x for x in words[max(0, k - 2) : k + 3] if x not in _POINT_SET]
            if sum(x in _NAME_SET or x[0].isdigit() or x[-1].isdigit() for x in near) > 1:
                return True
    return False


def _may_mark(low: str) -> bool:
    return any(x in low for x in _MARK_WORDS) or "plus" in low or "+" in low or (any(x in low for x in "[({<") and any(x in low for x in _BRACKETS))


def disguised_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only in the rewritten text, and meet no plain one but those that they hold and exceed."""
    odd, low = not text.isascii() and not _PLAIN_FORM.keys().isdisjoint(set(text)), text.lower()
    alike = _GLUED(low) is not None and _LOOKS_LIKE_NUMBER.search(text) is not None
    if not odd and not alike and not _may_spell(low) and not _may_mark(low):
        return []
    found: list[Span] = []
    for fuse in (False, True):
        r = Rewritten(text)
        if odd:
            _plain_letters(r)
            low = r.text.lower()
        if odd or alike:
            _plain_numbers(r)
            low = r.text.lower()
        bounds = _may_spell(low) and bool(_NAMES_NEAR.search(r.text)) and _plain_digits(r, fuse)
        low = r.text.lower()
        if _may_mark(low):
            if _MARK.search(r.text):
                _plain_marks(r)
            _plain_points(r)
        found += _rewritten_spans(r, base, found)
        if not bounds:
            break
        low = text.lower()
    return found


class _Places:
    """Spans by place."""

    def __init__(self, spans: list[Span]):
        self.at = sorted((s, e) for _, s, e in spans)
        self.heads, self.upto = [s for s, _ in self.at], list(accumulate((e for _, e in self.at), max))

    def meet(self, lo: int, hi: int) -> bool:
        k = bisect_left(self.heads, hi)
        # Of the spans that begin before its end, the one that ends last.
        return k > 0 and self.upto[k - 1] > lo

    def exceeded(self, lo: int, hi: int) -> bool:
        """Whether all spans that meet the range lie in it, and none is all of it."""
        first = bisect_left(self.heads, lo)
        if first and self.upto[first - 1] > lo:
            return False
        return all(e <= hi and (s, e) != (lo, hi) for s, e in self.at[first : bisect_left(self.heads, hi)])


def _rewritten_spans(r: Rewritten, base: list[Span], before: list[Span]) -> list[Span]:
    """Identifiers of the rewritten text that rest on a rewritten part, meet no span found before, and hold whole, and
    more than, each plain span that they meet: a plain pattern sees but a part of a disguised identifier."""
    if not any(r.new):
        return []
    plain, taken, found = _Places(base), _Places(before), []
    for kind, s, e in base_spans(r.text):
        if any(r.new[s:e]):
            lo, hi = r.start[s], r.end[e - 1]
            if not taken.meet(lo, hi) and plain.exceeded(lo, hi):
                found.append((kind, lo, hi))
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(text: str) -> tuple[list[Span], list[Span]]:
    """(plain spans, all spans), each in order."""
    base = base_spans(text)
    more = disguised_spans(text, base)
    return base, in_order(base + more) if more else base


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span put as <KIND>; of overlapping spans the union is put once, as the first one's kind."""
    out, at = [], 0
    for kind, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def pii_column(text: Column) -> Column:
    """A struct: base and spans (arrays of kind, start, end in code points, end exclusive), base_sha256, spans_written,
    n_base, masked."""
    span = "array<struct<kind:string,start:int,end:int>>"

    @F.pandas_udf(f"base_sha256 string, spans_written string, spans {span}, n_base int, masked string")
    def column(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, every = detect(t)
            rows.append((hashlib.sha256(written(base).encode()).hexdigest(), written(every), [{"kind": k, "start": s, "end": e} for k, s, e in every], len(base), masked(t, every)))
        return pd.DataFrame(rows, columns=["base_sha256", "spans_written", "spans", "n_base", "masked"])

    return column(text)


def with_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds pii_column of the text; a column named as ``out`` is replaced, all others stay.

    A null text is read as empty: no spans, masked text empty. All rows stay, repeated ones too; an empty table stays
    empty. Texts are read whole, in time in proportion to their length.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(out, pii_column(whole_text(text)))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """Puts <EMAIL>, <IP>, <CARD> or <PHONE> in place of each span; the other columns stay as they are, whatever their
    names, null texts stay null, and all rows stay."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, F.when(F.col(text).isNotNull(), pii_column(whole_text(text))["masked"]))
