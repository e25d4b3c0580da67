"""Places of token phrases: texts and their phrases are sorted by id, and each phrase is looked up as it passes its text.

Runs of 1, 2, 4, ... tokens of the text are numbered, each by the numbers of its halves, as far as phrases ask for them. A
phrase stands where its first and its last run of the largest such length do; numbers are equal where tokens are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.ngrams import dealt
from palimpsest.sources.shared import small_batches


class Runs:
    """The runs of a token list by number: for each length of 1, 2, 4, ... the numbers by place, those of pairs of halves,
    and the places by number."""

    def __init__(self, words: list):
        self.levels = [self._numbered(words)]

    @staticmethod
    def _numbered(keys: list) -> tuple[list[int], dict, list[list[int]]]:
        known: dict = {}
        numbers = [known.setdefault(k, len(known)) for k in keys]
        places: list[list[int]] = [[] for _ in known]
        for i, n in enumerate(numbers):
            places[n].append(i)
        return numbers, known, places

    def of(self, phrase: list) -> list[int]:
        """The places of a phrase of one token or more."""
        own = list(phrase)
        for level in range(len(phrase).bit_length()):
            if level:
                half = 1 << level - 1
                if level == len(self.levels):
                    numbers = self.levels[-1][0]
                    self.levels.append(self._numbered(list(zip(numbers, numbers[half:]))))
                own = list(zip(own, own[half:]))
            known = self.levels[level][1]
            own = [known.get(k) for k in own]
            if None in own:
                return []
        numbers, _, places = self.levels[level]
        if len(own) == 1:
            return places[own[0]]
        behind = len(own) - 1
        return [i for i in places[own[0]] if i + behind < len(numbers) and numbers[i + behind] == own[-1]]


def phrase_places(texts: DataFrame, phrases: DataFrame, id_col: str = "example_id", words: str = "words", phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """(id, phrase id, pos): every 0-based place of each phrase in the text of its id.

    texts: an id, and its tokens; ids are unique. phrases: the text's id, an id among the text's phrases, and the tokens.
    Null and empty phrases, null ids and phrases without a text have no place; overlapping places count each. One shuffle
    brings phrases behind their text; a task holds one text at a time, whatever the number of its phrases.
    """
    small_batches(texts.sparkSession)
    asked = phrases.select(F.col(id_col).alias("id"), F.col(phrase_id).alias("phrase_id"), F.col(phrase).alias("tokens"), F.lit(True).alias("asks")).where(F.size("tokens") > 0)
    kind = asked.schema["phrase_id"].dataType.simpleString()
    held = texts.select(F.col(id_col).alias("id"), F.lit(None).cast(kind).alias("phrase_id"), F.col(words).alias("tokens"), F.lit(False).alias("asks"))
    sorted_ = dealt(held.unionByName(asked).where("id is not null"), "id").sortWithinPartitions("id", "asks")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs = None, None
        for batch in batches:
            row, at = [], []
            for k, (id_, tokens, asks) in enumerate(zip(batch["id"].to_pylist(), batch["tokens"].to_pylist(), batch["asks"].to_pylist(), strict=True)):
                if not asks:
                    now, runs = id_, Runs(tokens or [])
                elif id_ == now and (found := runs.of(tokens)):
                    row += [k] * len(found)
                    at += found
                if len(at) >= 1 << 16:
                    yield _placed(batch, row, at)
                    row, at = [], []
            yield _placed(batch, row, at)

    found = sorted_.mapInArrow(look_up, f"id {sorted_.schema['id'].dataType.simpleString()}, phrase_id {kind}, pos int")
    return found.select(F.col("id").alias(id_col), F.col("phrase_id").alias(phrase_id), "pos")


def _placed(batch: pa.RecordBatch, row: list[int], at: list[int]) -> pa.RecordBatch:
    rows = pa.array(row, pa.int64())
    return pa.RecordBatch.from_arrays([batch["id"].take(rows), batch["phrase_id"].take(rows), pa.array(at, pa.int32())], names=["id", "phrase_id", "pos"])


def phrase_counts(texts: DataFrame, phrases: DataFrame, id_col: str = "example_id", words: str = "words", phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """(id, phrase id, places): how often each phrase stands in the text of its id, 0 included."""
    found = phrase_places(texts, phrases, id_col, words, phrase_id, phrase).groupBy(id_col, phrase_id).agg(F.count("*").alias("places"))
    return phrases.select(id_col, phrase_id).join(found, [id_col, phrase_id], "left").select(id_col, phrase_id, F.coalesce("places", F.lit(0)).alias("places"))


def locate_longest(words: Column, phrase: Column, start: Column | int = 0) -> Column:
    """struct (place, skipped, length, ambiguous) of the part of the phrase that is looked for from a place on: it begins at
    the phrase's first token that stands there, and is the longest that occurs; null without such a token.

    place is the first of its places, skipped the tokens of the phrase before it, ambiguous whether it has others.
    """
    from_ = F.lit(start) if isinstance(start, int) else start
    rest = F.slice(words, from_ + 1, F.greatest(F.size(words) - from_, F.lit(0)))
    known = F.transform(phrase, lambda w: F.array_contains(rest, w))
    skipped = F.array_position(known, F.lit(True)).cast("int") - 1
    part = F.slice(phrase, F.greatest(skipped, F.lit(0)) + 1, F.size(phrase))
    starts = F.filter(F.transform(rest, lambda w, i: F.when(w == F.get(part, F.lit(0)), i)), lambda i: i.isNotNull())

    def run(i: Column) -> Column:
        """How many tokens agree from a place on."""
        pairs = F.arrays_zip(F.slice(rest, i + 1, F.size(part)).alias("a"), part.alias("b"))
        apart = F.array_position(F.transform(pairs, lambda p: ~p["a"].eqNullSafe(p["b"])), F.lit(True))
        return F.when(apart > 0, apart - 1).otherwise(F.size(part)).cast("int")

    runs = F.transform(starts, lambda i: F.struct(run(i).alias("length"), (-i).alias("at")))
    best = F.array_max(runs)
    several = F.size(F.filter(runs, lambda r: r["length"] == best["length"])) > 1
    return F.when(skipped >= 0, F.struct((from_ - best["at"]).alias("place"), skipped.alias("skipped"), best["length"].alias("length"), several.alias("ambiguous")))
