"""Phrase places, the longest part that occurs, and numbering inside groups, against plain rewrites."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import phrases, plans
from palimpsest.sources import lines


def _places(words, phrase):
    return [i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase] if phrase else []


def test_phrase_places_match_a_plain_search(spark):
    """Repeated tokens, phrases longer than the text, empty and null phrases, ids without a text, null tokens."""
    rnd = random.Random(2)
    texts = {k: rnd.choices("ab" if k % 2 else "abcd", k=rnd.randint(0, 60)) for k in range(12)} | {12: ["x"] * 200, 13: []}
    asked = []
    for k, words in [*texts.items(), (99, ["a"])]:
        for n in (0, 1, 2, 3, 4, 5, 7, 8, 9, 33, 70, 130):
            at = rnd.randint(0, max(0, len(words) - n))
            asked.append((k, len(asked), words[at : at + n] if rnd.random() < 0.7 else rnd.choices("abcd", k=n)))
    asked.append((1, -1, None))
    t = spark.createDataFrame(list(texts.items()), "example_id long, words array<string>")
    p = spark.createDataFrame([(*a, "q", 1) for a in asked], "example_id long, phrase_id long, phrase array<string>, words string, pos int")
    got = sorted(map(tuple, phrases.phrase_places(t, p).collect()))
    want = sorted((k, n, at) for k, n, x in asked for at in _places(texts.get(k, []), x or []))
    assert got == want and len(want) > 500
    counts = {(r.example_id, r.phrase_id): r.places for r in phrases.phrase_counts(t, p).collect()}
    assert counts == {(k, n): len(_places(texts.get(k, []), x or [])) for k, n, x in asked}
    assert phrases.phrase_places(t.limit(0), p).count() == phrases.phrase_places(t, p.limit(0)).count() == 0


def _longest(words, phrase, start):
    for i in range(len(phrase)):
        for j in range(len(phrase), i, -1):
            at = [x for x in _places(words, phrase[i:j]) if x >= start]
            if at:
                return at[0], i, j - i, len(at) > 1
    return None


def test_longest_part_matches_trying_all(spark):
    rnd = random.Random(7)
    rows = [(rnd.choices("abc", k=rnd.randint(0, 14)), rnd.choices("abcz", k=rnd.randint(0, 6)), rnd.randint(0, 5)) for _ in range(300)]
    df = spark.createDataFrame(rows, "words array<string>, phrase array<string>, start int")
    got = [r.x and tuple(r.x) for r in df.select(phrases.locate_longest(F.col("words"), F.col("phrase"), F.col("start")).alias("x")).collect()]
    want = [_longest(*r) for r in rows]
    assert got == want
    for (words, phrase, start), w in zip(rows, want):
        assert plans.locate_longest(phrase, plans.Places(words), start) == (w and (w[0], w[1], w[3]))


def test_rows_are_numbered_inside_groups_of_any_size(spark):
    """One data set with nearly all rows, null groups and orders, many partitions, clashing names."""
    rnd = random.Random(1)
    rows = [("big" if k % 50 else rnd.choice([None, "s", "t"]), rnd.choice(["train", None]), k * 7 % 5003, k, "r") for k in range(5003)]
    df = spark.createDataFrame(rows, "dataset string, split string, example_id long, at long, row string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that small ranges are not put together again
    try:
        for small, parts in ((lines.SMALL_PARTS, 9), (0, 2)):
            lines.SMALL_PARTS, kept = small, lines.SMALL_PARTS
            try:
                got = lines.number_rows(df.repartition(parts), ["example_id"], ["dataset", "split"])
                assert got.columns == [*df.columns, "line_no"]
                numbers = {(r.dataset, r.split, r.example_id): r.line_no for r in got.collect()}
            finally:
                lines.SMALL_PARTS = kept
            groups = {}
            for d, s, e, *_ in rows:
                groups.setdefault((d, s), []).append(e)
            assert numbers == {(*g, e): n for g, own in groups.items() for n, e in enumerate(sorted(own))}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    again = lines.number_rows(got, ["example_id"], ["dataset", "split"])
    assert again.columns == got.columns and again.count() == len(rows)
    assert lines.number_rows(df.limit(0), ["example_id"], ["dataset"]).count() == 0
