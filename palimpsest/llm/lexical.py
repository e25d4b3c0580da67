"""Ranked lexical search by dense blocked multiplication.

Every item (a query text) is a column of integer term weights, every document a row of integer term impacts; a score is
their product. Items are dealt into tiles. For a batch of documents and a tile of items, both sides are compacted to the
terms that the tile's items and the batch share, laid out densely in float64 and multiplied by BLAS. Products and
partial sums stay whole numbers below 2**53, so they are exact; where the terms' bound would pass that, the vocabulary is
cut further and the parts are added as 64-bit integers. A task keeps each item's best documents so far and looks only at
scores that reach the worst of them, ties included; the tasks' few rows are ranked by a window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

#: A term in Java's and RE2's syntax: digits, letters and everything beyond ASCII; only A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Items of one tile.
ITEM_TILE = 256
#: (item, term) pairs of one pass over the documents, which the driver gathers and broadcasts.
MAX_PAIRS = 4_000_000
#: Whole numbers below this are exact in float64.
EXACT = 2**53
#: Saturation: impacts are at most SCALE / 1000, whatever the frequency.
SCALE = 1_000_000_000
#: Tasks' rows of one item that meet in the first of two rankings.
SPREAD = 64

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split()


def _texts(batch: pa.RecordBatch, at: int) -> list[bytes]:
    return batch.column(at).cast(pa.binary()).to_pylist()


class Items:
    """The items of a pass: their vocabulary and, by tile of items, the (term, item) pairs."""

    def __init__(self, pairs: list[tuple[int | None, bytes]]):
        self.ids = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i or 0))
        place = {i: k for k, i in enumerate(self.ids)}
        self.words = {w: k for k, w in enumerate(dict.fromkeys(w for _, w in pairs))}
        own = np.array([(place[i], self.words[w]) for i, w in pairs], dtype=np.int64).reshape(-1, 2)
        own = own[np.lexsort((own[:, 1], own[:, 0]))]
        cuts = np.searchsorted(own[:, 0], np.arange(0, len(self.ids) + ITEM_TILE, ITEM_TILE))
        self.tiles = [own[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    norm = 10 + (90 * length * n_docs) // n_terms
    return (SCALE * tf) // (1000 * tf + 8 * norm)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of non-negative whole numbers in float64, exact, as 64-bit integers."""
    largest = float(a.max(initial=0)) * float(b.max(initial=0))
    width = a.shape[1] if not largest else max(1, int((EXACT - 1) // largest))
    total = np.zeros((a.shape[0], b.shape[1]), dtype=np.int64)
    for at in range(0, a.shape[1], width):
        total += (a[:, at : at + width] @ b[at : at + width]).astype(np.int64)
    return total


class Best:
    """The k best (score, document) of each item so far, by score and then by the smaller document, null the largest."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.ones(n_items, dtype=np.int64)
        self.item = self.score = self.doc = np.zeros(0, dtype=np.int64)
        self.none = np.zeros(0, dtype=bool)
        self.waiting: list[tuple] = []
        self.held = 0

    def offer(self, first_item: int, scores: np.ndarray, doc: np.ndarray, none: np.ndarray) -> None:
        """scores: documents by items of one tile."""
        row, column = np.nonzero(scores >= self.least[first_item : first_item + scores.shape[1]])
        self.waiting.append((column + first_item, scores[row, column], doc[row], none[row]))
        self.held += len(row)
        if self.held > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        own = zip((self.item, self.score, self.doc, self.none), *self.waiting, strict=True)
        item, score, doc, none = (np.concatenate(x) for x in own)
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[nth < self.k]
        self.item, self.score, self.doc, self.none = item[nth < self.k], score[kept], doc[kept], none[kept]
        full = nth[nth < self.k] == self.k - 1
        # A later document with the same score still enters if its id is smaller, so the bound itself passes.
        self.least[self.item[full]] = self.score[full]
        self.waiting, self.held = [], 0


def _counted(docs: DataFrame, text: str, words: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the documents that hold each word."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, n_docs, n_terms, found = held.value.get, 0, 0, Counter()
        for batch in batches:
            for own in map(terms, _texts(batch, 0)):
                n_docs, n_terms = n_docs + bool(own), n_terms + len(own)
                found.update(set(map(get, own)))
        found.pop(None, None)
        rows = [(-1, n_docs), (-2, n_terms), *found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["word", "n"])

    sums = docs.select(whole_text(text)).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = {r.word: r.n for r in sums.collect()}
    return got.get(-1, 0), got.get(-2, 0), np.array([got.get(k, 0) for k in range(len(words))], dtype=np.int64)


def _search(docs: DataFrame, items: Items, k: int, id_col: str, text: str) -> DataFrame:
    n_docs, n_terms, df = _counted(docs, text, items.words)
    held = docs.sparkSession.sparkContext.broadcast((items, weights(n_docs, df)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = held.value
        get, best = items.words.get, Best(k, len(items.ids))
        for batch in batches:
            row, word, tf, length = [], [], [], []
            for at, own in enumerate(map(terms, _texts(batch, 1))):
                counts = Counter(map(get, own))
                counts.pop(None, None)
                row += [at] * len(counts)
                word += counts.keys()
                tf += counts.values()
                length += [len(own)] * len(counts)
            if not row:
                continue
            row, word, tf, length = (np.array(x, dtype=np.int64) for x in (row, word, tf, length))
            impact = impacts(tf, length, n_docs, n_terms)
            ids = batch.column(0)
            doc, none = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            there = np.zeros(len(items.words), dtype=bool)
            there[word] = True
            for pairs in items.tiles:
                shared = pairs[there[pairs[:, 1]]]
                own_words = np.unique(shared[:, 1])
                if not len(own_words):
                    continue
                compact = np.full(len(items.words), -1, dtype=np.int64)
                compact[own_words] = np.arange(len(own_words))
                first = pairs[0, 0]
                item_tile = np.zeros((len(own_words), pairs[-1, 0] - first + 1))
                item_tile[compact[shared[:, 1]], shared[:, 0] - first] = weight[shared[:, 1]]
                at = compact[word]
                doc_tile = np.zeros((batch.num_rows, len(own_words)))
                doc_tile[row[at >= 0], at[at >= 0]] = impact[at >= 0]
                best.offer(first, multiply(doc_tile, item_tile), doc, none)
        best.settle()
        own = [items.ids[i] for i in best.item.tolist()]
        arrays = [pa.array(own, pa.int64()), pa.array(best.doc, pa.int64(), mask=best.none), pa.array(best.score, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "id", "score"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), whole_text(text)).mapInArrow(rank, "item_id long, id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text",
           max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(item id, rank, document id, score): each item's k best documents with a score above 0, all if fewer.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, of the whole text. Null, empty and
    term-less texts have none: such documents don't count in the statistics, such items give no rows. Rows of equal item
    id, null included, are one item with all their terms; a repeated document row is one document for each row. Equal
    scores go by the smaller document id, null last. Either table empty: no rows. Other columns are not looked at.

    The distinct (item, term) pairs are counted first; up to max_pairs are gathered and broadcast, more are dealt by item
    id into passes over the documents, each within that bound.
    """
    folded = F.translate(whole_text(text), UPPER, LOWER)
    found = F.explode(F.array_distinct(F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))))
    pairs = items.select(F.col(item_col).cast("long").alias("item"), found.alias("term")).distinct()
    passes = max(1, -(-pairs.count() // max_pairs))
    parts = []
    for nth in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == nth) if passes > 1 else pairs
        parts.append(_search(docs, Items([(r.item, r.term.encode()) for r in own.collect()]), k, id_col, text))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    by = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    rows = rows.withColumn("salt", F.spark_partition_id() % SPREAD)
    for keys in (["item_id", "salt"], ["item_id"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)
    return rows.select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score")
