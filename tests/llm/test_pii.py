"""Disguised personal data against a plain character-by-character transducer, and at any length."""

import random
import re
import time
import unicodedata

import pytest

from palimpsest.llm import pii

ALIKE = {"а": "a", "е": "e", "о": "o", "с": "c", "·": ".", "․": ".", "–": "-", "‑": "-", "​": "", "­": ""}


def _slow_letters(text):
    """Every character's ASCII form by itself, then the plain patterns, then the way back."""
    out, source, new = "", [], []
    for i, c in enumerate(text):
        put = c
        if ord(c) > 127:
            form = ALIKE.get(c, unicodedata.normalize("NFKC", c))
            put = form if form.isascii() else c
        for x in put:
            out += x
            source.append(i)
            new.append(put != c)
        if not put and new:
            new[-1] = True
    base = pii.base_spans(text)
    found = []
    for kind, s, e in pii.base_spans(out):
        lo, hi = source[s], source[e - 1] + 1
        # A plain span that it meets is a part of it, and not all of it.
        if any(new[s:e]) and all(lo <= a and b <= hi and (a, b) != (lo, hi) for _, a, b in base if a < hi and lo < b):
            found.append((kind, lo, hi))
    return sorted(found)


def test_letters_match_a_plain_transducer():
    rnd = random.Random(3)
    parts = ["ﬁ", "ａ", "а", "о", "с", "·", "․", "＠", "@", ".", "–", "-", "1", "２", "³", "¹", "4111", "​", "­", " ", " ", "+", "＋", "é", "com", "x", "192.168.", "①"]
    hits = 0
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 22)))
        r = pii.Rewritten(text)
        pii._plain_letters(r)
        got, want = sorted(pii._rewritten_spans(r, pii.base_spans(text), [])), _slow_letters(text)
        assert got == want, text
        hits += len(want)
    assert hits > 300


def _word(rnd, n=7):
    # No part of these is a digit's name, a sign's name or a word for "at".
    return "".join(rnd.choice("bglmqvwxyz") for _ in range(rnd.randint(1, n)))


def test_planted_disguises_map_back_at_any_length():
    rnd = random.Random(4)
    names = {v: k for k, v in list(pii._DIGIT_NAMES.items())[:11] if k != "oh"}
    for turn in range(1500):
        dot, at = rnd.choice([" dot ", "[dot]", " (dot) ", "{.}", " punkt "]), rnd.choice([" [at] ", "(at)", " {@} ", " at ", " arroba "])
        long = 90 if turn % 10 == 0 else 7
        mail = dot.join(_word(rnd, long) for _ in range(rnd.randint(1, 9))) + at + dot.join(_word(rnd, long) for _ in range(rnd.randint(2, 6)))
        ip = rnd.choice([" dot ", "[.]", " (dot) "]).join(str(rnd.randint(0, 255)) for _ in range(4))
        phone = "plus " + " ".join(names[rnd.choice("0123456789")] for _ in range(rnd.randint(10, 13)))
        kind, secret = rnd.choice([("email", mail), ("ip", ip), ("phone", phone)])
        before, after = _word(rnd) + ": ", rnd.choice(["; ", ") ", "! "]) + _word(rnd)
        text = before + secret + after
        base, every = pii.detect(text)
        assert base == [] and every == [(kind, len(before), len(before) + len(secret))], text


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("jane [at] " + "a" * 150 + " [dot] com", "email", None), ("a dot b dot c dot d dot e dot f dot g at example dot com", "email", None),
    ("ﬁrst@example．com", "email", None), ("jane@example·com", "email", None), ("4111 1111 1111 111¹", "card", None),
    ("jane_at_example_dot_com", "email", None), ("٤١١١ ١١١١ ١١١١ ١١١١", "card", None),
    ("jane" + "." + "b" * 300 + " [at] x [dot] y", "email", None), ("we met jane at work", None, ""), ("look_at_me.com", None, ""), ("see [at] it", None, ""),
])
def test_whole_disguises(text, kind, found):
    base, every = pii.detect(text)
    assert base == [] and every == ([(kind, 0, len(text))] if kind else [])


def test_disguised_spans_never_meet_plain_ones():
    """Ten addresses of hosts inside one plain address, and a written card over its domain."""
    local = "-".join(f"1.2.3.{i}" for i in range(10))
    text = f"{local}@four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one.com"
    base, every = pii.detect(text)
    assert len(base) == 11
    for kind, s, e in every:
        assert (kind, s, e) in base or not any(a < e and s < b for _, a, b in base)


@pytest.mark.parametrize(("text", "kind", "secret"), [
    ("mail jаne.doe@example.com now", "email", "jаne.doe@example.com"), ("jane.d\u200boe@example.com", "email", "jane.d\u200boe@example.com"),
    ("ask jane dot doe@example.com", "email", "jane dot doe@example.com"), ("jane@mail.example dot com", "email", "jane@mail.example dot com"),
    ("call +49 171 234567８", "phone", "+49 171 234567８"), ("12.34.56.7８", "ip", "12.34.56.7８"), ("card 4lll 1111 1111 1111.", "card", "4lll 1111 1111 1111"),
    ("4111 1111 1111 111one", "card", "4111 1111 1111 111one"), ("+49 l71 2345678", "phone", "+49 l71 2345678"), ("l92.168.O.1", "ip", "l92.168.O.1"),
])
def test_whole_identifiers_around_plain_parts(text, kind, secret):
    base, every = pii.detect(text)
    at = text.index(secret)
    assert (kind, at, at + len(secret)) in every and set(base) <= set(every)
    assert pii.masked(text, every) == text.replace(secret, f"<{kind.upper()}>")
    assert base == pii.base_spans(text)


def test_a_look_alike_at_any_place():
    """A homoglyph at every place of an address, and every form of a digit at every place of a number, are masked whole."""
    mail = "jane.doe@exampxe.com"
    alike = {a: b for b, a in ALIKE.items() if a} | {"j": "ј", "x": "х", "p": "р", "d": "ԁ", "@": "＠", "n": "ｎ", "m": "ｍ"}
    for at, c in enumerate(mail):
        text = f"to {mail[:at]}{alike[c]}{mail[at + 1 :]}!"
        assert pii.masked(text, pii.detect(text)[1]) == "to <EMAIL>!", text
    names = {v: k for k, v in list(pii._DIGIT_NAMES.items())[:11] if k != "oh"}
    for kind, number in (("card", "4111 1111 1111 1111"), ("ip", "12.34.56.78"), ("phone", "+49 171 2345678")):
        for at, c in enumerate(number):
            if c.isdigit():
                for put in (chr(0xFF10 + int(c)), chr(0x660 + int(c)), names[c], *[k for k, v in pii._DIGITS_ALIKE.items() if v == c]):
                    text = f"see {number[:at]}{put}{number[at + 1 :]}!"
                    assert pii.masked(text, pii.detect(text)[1]) == f"see <{kind.upper()}>!", text


@pytest.mark.parametrize("text", ["Il 2020 loll", "I saw 10 lions, l and O", "version 1.0.l", "lol lol lol lol lol", "a1one b2two", "one1", "O.o.O.o", "Im Jahr 1999 I 20 I 30 I 40"])
def test_ordinary_words_are_no_numbers(text):
    assert pii.detect(text) == ([], [])


@pytest.mark.parametrize("text", ["1o" * 60_000, "1one " * 30_000, "l" * 120_000, "1 l" * 60_000, " " * 200_000 + "[at]", "a dot " * 30_000, "a at " * 30_000 + "b dot c", "[at] " * 30_000, "+ " * 60_000, "a." * 60_000 + " [at] b", "one " * 40_000, "ﬁ" * 60_000, "1.2.3.4 one " * 10_000])
def test_very_long_texts_take_linear_time(text):
    began = time.time()
    base, every = pii.detect(text)
    assert time.time() - began < 10 and all(re.fullmatch("email|ip|card|phone", k) and 0 <= s < e <= len(text) for k, s, e in every)
