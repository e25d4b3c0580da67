"""Java tokens of texts that are too long or malformed."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import code
from palimpsest.operators import corrupt
from palimpsest.plans import more

SIGNS = [*"aZ_$5.(){}[];,@-+*/%&|^<>=!~?:\"'\\#`§é中😀\u0085\u2028\r\n\t ", "//", "/*", "*/", "...", "ab", "0x1f", "1e5"]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(7)
    held = ["".join(rnd.choices(SIGNS, k=rnd.randint(0, 12))) for _ in range(1500)]
    held += ["a b c d", " a b c d ", " a b c d e ", '"a b c d e f"', "a // b c d e f\n", "a /* b c d e f */ b", "a+b+c", *SIGNS]
    return spark.createDataFrame([(x,) for x in [*held, None]], "c string").coalesce(1)


def test_strays_are_those_of_the_kinds(texts):
    own = code.java_tokens(F.col("c"))
    want = F.when(F.exists(own, lambda t: code.java_kind(t) == "stray"), F.array().cast("array<string>")).otherwise(own)
    got = texts.select("c", code.tokenize_java(F.col("c")).alias("got"), want.alias("want")).collect()
    assert [r for r in got if r.got != r.want] == []
    assert len({bool(r.got) for r in got}) == 2


@pytest.mark.parametrize("most", [1, 4, 5])
def test_more_than_most_tokens_give_none(texts, most):
    got = texts.select("c", code.tokenize_java(F.col("c"), most).alias("got"), code.tokenize_java(F.col("c")).alias("all")).collect()
    for r in got:
        assert r.got == (r["all"] if r["all"] is None or len(r["all"]) <= most else []), r


def test_long_lines_of_code_are_not_taken_apart(spark, monkeypatch):
    """The tokens are replaced by ones that raise when they are made of a long line."""
    lines = spark.createDataFrame([(1, "x " * 600), (2, "int x = 5 ; " * 3)], "id long, text string").coalesce(1)
    failing = F.raise_error(F.lit("taken apart")).cast("array<string>")
    monkeypatch.setattr(code, "java_tokens", lambda c: F.when(F.length(c) > 100, failing).otherwise(F.split(F.trim(c), " ")))
    assert [r.id for r in corrupt.corrupt_code(lines).select("id").collect()] == [2]


def test_no_letters_is_every_other_character(spark):
    found = spark.range(0x110000).where("id < 55296 or id > 57343").selectExpr("id", "substring(decode(unhex('00000061' || lpad(hex(id), 8, '0')), 'UTF-32'), 2) as c")
    assert found.where(F.length("c") != 1).count() == 0
    bad = found.where(F.col("c").rlike(more._NO_LETTERS) == F.col("c").rlike("[A-Za-z ]"))
    assert bad.count() == 0
