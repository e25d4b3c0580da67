"""Sums over the grams of a row, taken inside the task that holds its texts: no gram becomes a row of its own.

What a metric needs of an example's grams is a handful of sums. The sides are token arrays beside each other in one row;
a batch's tokens are numbered, and a gram's number comes from that of the gram one shorter and the token behind it, so
counts are exact. Batches are cut into slices of bounded tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.shared import small_batches

#: Tokens that are counted together; a row with more is counted alone.
SLICE_TOKENS = 1 << 18


class Grams(NamedTuple):
    """The distinct grams of one order in a slice of rows, those of a row in the order of its sides and tokens: their rows,
    the last token's number in words, a digest of 16 bytes, and, for each place where a gram stands, its number and side."""

    n: int
    row: np.ndarray
    last: np.ndarray
    words: pa.Array
    digest: np.ndarray | None
    number: np.ndarray
    side: np.ndarray

    def counts(self, sides: int) -> np.ndarray:
        """Each gram's count on each of a few sides."""
        return np.bincount(self.number * sides + self.side, minlength=len(self.row) * sides).reshape(len(self.row), sides)

    def pairs(self, sides: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(gram, side, count) where a count is not 0, for any number of sides."""
        at, found = pd.factorize(self.number * sides + self.side)
        return found // sides, found % sides, np.bincount(at, minlength=len(found))


class Texts(NamedTuple):
    """Texts of a slice one behind the other: tokens, and for each text its row, its side and its length."""

    words: pa.Array
    row: np.ndarray
    side: np.ndarray
    size: np.ndarray


def grams(texts: Texts, orders: int, breaks: str | None = None, digests: bool = False) -> Iterator[Grams]:
    """The grams of each order. Grams with a null token, or one that holds the string ``breaks``, are left out."""
    held = texts.words.dictionary_encode()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    words = held.dictionary
    token = held.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    good = token >= 0
    if breaks is not None and len(words):
        good &= ~pc.match_substring(words, breaks).to_numpy(zero_copy_only=False)[token]
    row, side = np.repeat(texts.row, texts.size), np.repeat(texts.side, texts.size)
    left = np.repeat(np.cumsum(texts.size), texts.size) - np.arange(len(token))  # tokens of the text from here on
    many, number, at = max(len(words), 1), row, np.arange(len(token))
    if digests:
        # Two hashes of each token, and of a gram the sums of its tokens' products with powers of odd numbers.
        own = np.stack([pd.util.hash_array(np.asarray(words.to_pylist(), dtype=object), hash_key=key, categorize=False) for key in ("0123456789abcdef", "fedcba9876543210")]) if len(words) else np.zeros((2, 0), dtype=np.uint64)
        odd, mixed = np.array([[0x9E3779B97F4A7C15], [0xC2B2AE3D27D4EB4F]], dtype=np.uint64), np.zeros((2, len(token)), dtype=np.uint64)
    for n in range(1, orders + 1):
        fits = (left[at] >= n) & good[np.minimum(at + n - 1, max(len(token) - 1, 0))]
        at, number = at[fits], number[fits]
        last = token[at + n - 1]
        number, found = pd.factorize(number * many + last)
        whose, digest = np.empty(len(found), dtype=np.int64), None
        whose[number] = row[at]
        if digests:
            mixed = mixed[:, fits] * odd + own[:, last] + np.uint64(n)
            digest = np.empty((len(found), 2), dtype=np.uint64)
            digest[number] = mixed.T
        yield Grams(n, whose, found % many, words, digest, number, side[at])


def lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and its lists' lengths, null ones as empty."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten(), size


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with SLICE_TOKENS tokens at most, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + SLICE_TOKENS, "right")), start + 1)
        yield start, stop
        start = stop


def _side_texts(columns: list[pa.Array]) -> Texts:
    parts = [lists(c) for c in columns]
    rows = len(columns[0])
    return Texts(
        pa.concat_arrays([p[0] for p in parts]), np.tile(np.arange(rows), len(parts)), np.repeat(np.arange(len(parts)), rows),
        np.concatenate([p[1] for p in parts]),
    )


def nested_texts(column: pa.Array) -> Texts:
    inner, many = lists(column)
    words, size = lists(inner)
    return Texts(words, np.repeat(np.arange(len(column)), many), np.arange(len(inner)) - np.repeat(np.cumsum(many) - many, many), size)


#: From a slice's texts, its grams order by order, its number of rows and its slices of further columns: an array over the
#: rows for each field of the result.
Summing = Callable[..., dict[str, np.ndarray]]
_KINDS = {"long": pa.int64(), "double": pa.float64()}


def _summed(schema: str, parts: Iterator[tuple], orders: int, summing: Summing, breaks: str | None) -> pa.Array:
    fields = [pa.field(f.split()[0], _KINDS[f.split()[1]]) for f in schema.split(",")]
    found = []
    for texts, rows, more in parts:
        sums = summing(texts, grams(texts, orders, breaks), rows, *more)
        found.append(pa.StructArray.from_arrays([pa.array(np.asarray(sums[f.name]), type=f.type, safe=False) for f in fields], fields=fields))
    return pa.concat_arrays(found) if found else pa.array([], type=pa.struct(fields))


def _ddl(schema: str) -> str:
    return "struct<" + ",".join(":".join(f.split()) for f in schema.split(",")) + ">"


def side_sums(rows: DataFrame, sides: list[Column], schema: str, summing: Summing, orders: int, breaks: str | None = None, more: tuple[Column, ...] = ()) -> DataFrame:
    """Adds a struct column ``sums`` of long and double fields. sides: a token array each."""
    small_batches(rows.sparkSession)
    many = len(sides)

    @F.arrow_udf(_ddl(schema))
    def column(*columns: pa.Array) -> pa.Array:
        def parts():
            for start, stop in _slices(sum(lists(c)[1] for c in columns[:many])):
                own = [c.slice(start, stop - start) for c in columns]
                yield _side_texts(own[:many]), stop - start, own[many:]

        return _summed(schema, parts(), orders, summing, breaks)

    return rows.withColumn("sums", column(*sides, *more))


def nested_slices(held: pa.Array) -> Iterator[tuple[int, int]]:
    inner, many = lists(held)
    each, ends = np.concatenate([[0], np.cumsum(lists(inner)[1])]), np.cumsum(many)
    yield from _slices(each[ends] - each[ends - many])


def nested_sums(rows: DataFrame, texts: Column, schema: str, summing: Summing, orders: int, more: tuple[Column, ...] = ()) -> DataFrame:
    """Adds a struct column ``sums`` of an array of token arrays, whose places are the sides."""
    small_batches(rows.sparkSession)

    @F.arrow_udf(_ddl(schema))
    def column(held: pa.Array, *others: pa.Array) -> pa.Array:
        def parts():
            for start, stop in nested_slices(held):
                yield nested_texts(held.slice(start, stop - start)), stop - start, [c.slice(start, stop - start) for c in others]

        return _summed(schema, parts(), orders, summing, None)

    return rows.withColumn("sums", column(texts, *more))


def by_row(g: Grams, rows: int, value: np.ndarray) -> np.ndarray:
    """The sum of a value of each gram over the grams of each row."""
    return np.bincount(g.row, weights=value, minlength=rows)
