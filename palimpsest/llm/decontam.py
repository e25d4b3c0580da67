"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are word sequences. A CGK random walk reads a sequence at a pointer, puts out the word there, and moves on or
stays as a random bit for (step, word) says; two sequences at a small edit distance then agree at most steps, so edit
distance becomes Hamming distance. Each of several walks samples a few steps as a key. Windows of a document start at
every word; an item's windows start at each of its words, so an edit spoils only the keys that lie across it, and a
hit gives the place where the whole item would lie. A window is dropped as soon as the steps sampled so far lead to no
item. Every hit is verified by the exact edit distance of the whole item to the best-fitting item-sized window there.

How long walks are, how much they sample and how often they are repeated follows from a recall to be reached at the
largest number of edits allowed: ``plan`` tries it on made-up items, for short and for long ones apart. Items with
fewer than ten words are too short to walk over; a run of their words that the edits must leave whole is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

#: The least share of items at the limit of edits that the walks lead to, by trial.
RECALL = 0.97
#: The shortest items of each plan; shorter ones than the first are looked up by runs.
CLASSES = (10, 20)
#: Steps of a walk and how many of them a key samples, from the most selective on; repetitions that are tried.
WAYS = ((16, 7), (12, 6), (10, 5), (8, 5), (6, 4), (4, 3))
MOST_WALKS = 4
#: Repetitions beyond those that the trials need: edits in documents are not those of the trials.
SPARE_WALKS = 1
#: The longest walk.
STEPS = 16
SIMILARITY = 0.8
#: Items of one pass over the documents, by count and characters; larger benchmarks take several passes.
PASS_ITEMS = 20_000
PASS_CHARS = 20_000_000

_WORD = re.compile(r"\w+")
_PAD, _OTHER = 0, 1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _bits(words: int, walk: int) -> np.ndarray:
    """For each word number, the walk's bits of all steps."""
    x = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk + 1) * 0x1000003)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x * np.uint64(0x94D049BB133111EB)) >> np.uint64(32)


def _samples(walk: int, steps: int, samples: int) -> list[int]:
    """The sampled steps of a walk; the first step is always one of them."""
    rng = np.random.default_rng(walk)
    low = 2 if steps > 8 else 1
    return [0, *sorted(int(x) for x in rng.choice(np.arange(low, steps), samples - 1, replace=False))]


def _edited(rng: np.random.Generator, item: np.ndarray, edits: int, even: bool, fresh: int) -> np.ndarray:
    """The item after so many word edits, evenly spread, which spoils most keys, or at random places."""
    n = len(item)
    places = [(k + 1) * n // (edits + 1) for k in range(edits)] if even else rng.choice(n, edits, replace=False)
    words = item.tolist()
    for at in sorted(map(int, places), reverse=True):
        kind = rng.integers(3)
        words[at : at + (kind != 1)] = [] if kind == 2 else [fresh + at]
    return np.array(words, dtype=np.int64)


@lru_cache(maxsize=64)
def plan(similarity: float = SIMILARITY, recall: float = RECALL, trials: int = 120) -> tuple[tuple[int, int, int, int], ...]:
    """(shortest item, steps, samples, walks) for each class of lengths: the most selective way by which the class's
    shortest items, with as many edits as they may have, share a key with their edited form at least that often."""
    found = []
    for shortest in CLASSES:
        rng = np.random.default_rng(shortest)
        edits = int(shortest * (1 - similarity) + 1e-9)
        item, fresh = np.arange(2, shortest + 2), 2 * shortest
        bits = [_bits(4 * shortest, k) for k in range(MOST_WALKS)]
        pairs = [(rng.permutation(item), even) for even in (True, False) for _ in range(trials // 2)]
        pairs = [(a, _edited(rng, a, edits, even, fresh)) for a, even in pairs]
        for steps, samples in WAYS:
            met = np.zeros((MOST_WALKS, trials), dtype=bool)
            for k in range(MOST_WALKS):
                for t, both in enumerate(pairs):
                    keys = [set(zip(*(x.tolist() for x in outputs(np.append(w, np.zeros(STEPS + 1, dtype=np.int64)), np.arange(len(w)), bits[k], _samples(k, steps, samples))), strict=True)) for w in both]
                    met[k, t] = any(0 not in key for key in keys[0] & keys[1])
            reached = np.logical_or.accumulate(met).mean(axis=1) >= recall
            if reached.any():
                found.append((shortest, steps, samples, int(reached.argmax()) + 1 + SPARE_WALKS))
                break
        else:
            raise ValueError(f"no walk reaches a recall of {recall} at a similarity of {similarity}")
    return tuple(found)


def intact_run(size: int, edits: int) -> int:
    """The length of the longest run of an item's words that so many edits cannot but leave whole."""
    return -(-(size - edits) // (edits + 1))


class Benchmark:
    """The items of one pass: their words as numbers, and the walks' keys."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY, ways: tuple[tuple[int, int, int, int], ...] | None = None):
        self.items = [(i, w) for i, t in items if (w := words_of(t or ""))]
        self.similarity = similarity
        self.number: dict[str, int] = {}
        for _, words in self.items:
            for w in words:
                self.number.setdefault(w, len(self.number) + 2)
        self.sequences = [np.array([self.number[w] for w in words]) for _, words in self.items]
        self.pairs = [s[:-1] << 32 | s[1:] for s in self.sequences]
        gap = np.zeros(STEPS + 1, dtype=np.int64)
        self.flat = np.concatenate([x for s in self.sequences for x in (s, gap)]) if self.items else gap
        self.size = np.array([len(s) for s in self.sequences], dtype=np.int64)
        #: The edits that each item allows.
        self.most = (self.size * (1 - similarity) + 1e-9).astype(np.int64)
        size = self.size + len(gap)
        self.owner = np.repeat(np.arange(len(size)), size)
        self.head = np.cumsum(size) - size
        self.walks, self.runs = [], []
        if not self.items:
            return
        ways = ways or plan(similarity)
        bounds = [*(w[0] for w in ways), np.iinfo(np.int64).max]
        for (shortest, steps, samples, walks), beyond in zip(ways, bounds[1:], strict=True):
            own = (self.size >= shortest) & (self.size < beyond)
            if own.any():
                self.walks += [self._keys(k, _samples(k, steps, samples), own) for k in range(walks)]
        short = self.size < bounds[0]
        run = np.array([intact_run(n, e) if s else 0 for n, e, s in zip(self.size.tolist(), self.most.tolist(), short.tolist(), strict=True)])
        for n in sorted(set(run[short].tolist())):
            start = np.flatnonzero((self.flat > _OTHER) & (run == n)[self.owner])
            key = _run_keys(self.flat, start, n)
            start, key = start[key != 0], key[key != 0]
            order = np.argsort(key, kind="stable")
            self.runs.append((n, key[order], start[order]))

    def _keys(self, walk: int, steps: list[int], own: np.ndarray):
        """Bits, sampled steps, and for each number of samples the sorted prefixes of the keys; last, the starts."""
        bits = _bits(len(self.number) + 2, walk)
        start = np.flatnonzero((self.flat > _OTHER) & own[self.owner])
        prefixes, prefix = [], None
        for code in outputs(self.flat, start, bits, steps):
            prefix = code if prefix is None else _mix(prefix, code)
            prefixes.append(prefix)
        inside = prefixes[-1] != 0
        known = [np.unique(p) for p in prefixes[:-1]]
        order = np.argsort(prefixes[-1][inside], kind="stable")
        return bits, steps, known, prefixes[-1][inside][order], start[inside][order]


def outputs(flat: np.ndarray, start: np.ndarray, bits: np.ndarray, steps: list[int]) -> Iterator[np.ndarray]:
    """The words that walks from the starts put out at the sampled steps."""
    at = start.copy()
    for step in range(steps[-1] + 1):
        word = flat[at]
        if step in steps:
            yield word.astype(np.uint64)
        at += ((bits[word] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)


def _mix(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The key of one more sample; 0 if a sample is no item word, which no key of an item contains."""
    mixed = (prefix * np.uint64(0x9E3779B97F4A7C15)) ^ (word * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(29)
    return np.where((word > _OTHER) & (prefix != 0), mixed | np.uint64(1), np.uint64(0))


def _run_keys(flat: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The keys of the n words from each start on; 0 where one of them is no item word."""
    end = len(flat) - 1
    key = flat[start].astype(np.uint64)
    for k in range(1, n):
        key = _mix(key, flat[np.minimum(start + k, end)].astype(np.uint64))
    return key


def _among(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return sorted_[at] == x


def _hits(b: Benchmark, flat: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, item indexes) where the item would begin at the start; the same place can come more than once."""
    start0 = np.flatnonzero(flat > _OTHER)

    def places(start: np.ndarray, prefix: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(keys, prefix), np.searchsorted(keys, prefix, side="right")
        n = hi - lo
        which = starts[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        item = b.owner[which]
        return np.repeat(start, n) - (which - b.head[item]), item

    for bits, steps, known, keys, starts in b.walks:
        if not len(keys):
            continue
        start, at, prefix = start0, start0.copy(), flat[start0].astype(np.uint64)
        for step in range(steps[-1] + 1):
            word = flat[at]
            if step in steps[1:]:
                prefix = _mix(prefix, word.astype(np.uint64))
                keep = _among(known[steps.index(step)], prefix) if step != steps[-1] else _among(keys, prefix)
                keep &= prefix != 0
                start, at, prefix, word = start[keep], at[keep], prefix[keep], word[keep]
            at = at + ((bits[word] >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
        if len(start):
            yield places(start, prefix, keys, starts)
    for n, keys, starts in b.runs:
        key = _run_keys(flat, start0, n)
        keep = _among(keys, key) & (key != 0)
        if keep.any():
            yield places(start0[keep], key[keep], keys, starts)


def edit_distance(item: np.ndarray, window: np.ndarray, most: int) -> tuple[int, int]:
    """(distance, end): the smallest edit distance of the item to a part of the window, and where that part ends."""
    m = len(window)
    row, steps = np.zeros(m + 1, dtype=np.int64), np.arange(m + 1)
    for k, word in enumerate(item, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (window != word))
        row = np.minimum.accumulate(np.concatenate([[k], best]) - steps) + steps
        if row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def leaks(b: Benchmark, texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(text index, item index, edit distance, first word) of each item that a text holds, at its best place."""
    get, other = b.number.get, repeat(_OTHER)
    gap = [_PAD] * (STEPS + 1)
    flat_list, heads = [], []
    for t in texts:
        heads.append(len(flat_list))
        flat_list += map(get, words_of(t), other)
        flat_list += gap
    if not flat_list or not b.items:
        return []
    flat, head = np.array(flat_list, dtype=np.int64), np.array(heads)
    hits = [*_hits(b, flat)]
    if not hits:
        return []
    start, item = (np.concatenate(x) for x in zip(*hits, strict=True))
    # The item's place can be off by as much as the edits allow; a hit before a text's first word is that text's too.
    most, size = b.most[item], b.size[item]
    tail = np.append(head[1:], len(flat)) - len(gap)
    of_hit = np.searchsorted(head, np.maximum(start, 0) + most, side="right") - 1
    before = np.searchsorted(head, np.maximum(start, 0), side="right") - 1
    twice = before != of_hit
    text = np.concatenate([of_hit, before[twice]])
    start, item, most, size = (np.concatenate([x, x[twice]]) for x in (start, item, most, size))
    lo, hi = np.maximum(head[text], start - most), np.minimum(tail[text], start + size + most)
    # The item's words that its best part lacks are edits: too few item words, and no distance needs counting.
    among = np.concatenate([[0], np.cumsum(flat > _OTHER)])
    keep = (hi - lo >= size - most) & (among[np.maximum(hi, lo)] - among[lo] >= size - most)
    text, item, lo, hi, need = (x[keep] for x in (text, item, lo, hi, size - most))
    # A text's item has one window for each start, so these two name it.
    _, at = np.unique((text * len(b.items) + item) * (len(flat) + 1) + lo, return_index=True)
    where, need = np.stack([text, item, lo, hi])[:, at], need[at]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for (d, k, lo_, hi_), n in zip(where.T.tolist(), need.tolist(), strict=True):
        known = best.get((d, k))
        if known and known[0] == 0:
            continue
        sequence, window, most_ = b.sequences[k], flat[lo_:hi_], int(b.size[k]) - n
        # An edit spoils at most two of the item's word pairs; with fewer pairs left than that there is no match.
        pairs, there = b.pairs[k], np.sort(window[:-1] << 32 | window[1:])
        if len(pairs) and len(there) and np.count_nonzero(_among(there, pairs)) < len(pairs) - 2 * most_:
            continue
        distance, end = edit_distance(sequence, window, most_)
        place = (distance, max(0, lo_ - heads[d] + end - len(sequence)))
        if distance <= most_ and (known is None or place < known):
            best[d, k] = place
    return [(d, item, *place) for (d, item), place in sorted(best.items())]


def _passes(items: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of a checked size: one group for a small benchmark, several for a large one."""
    own = items.select(F.col(id_col).cast("long").alias("i"), whole_text(text).alias("t"))
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    groups = max(1, -(-n // PASS_ITEMS), -(-chars // PASS_CHARS))
    for k in range(groups):
        part = own if groups == 1 else own.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == k)
        yield [tuple(r) for r in part.distinct().sort("i", "t").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, item_id, edit_distance, n_words, first_word): every document and item such that a part of the document
    equals the item up to 1 - similarity of the item's words, at its best place.

    Words are lower-cased runs of letters, digits and underscores. Null and word-less texts hold and leak nothing; an
    empty table on either side gives no row. A repeated document gives its results again; a repeated item, of the same
    id and text, counts once, and equal texts under several ids give a row for each. A null id is kept as null. Of
    equally good places the first counts. Texts of any length are read whole; other columns are not looked at.
    Documents are read once for every PASS_ITEMS items or PASS_CHARS of their characters; one item alone can be longer.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kind = f"`{id_col}` long, item_id long, edit_distance long, n_words long, first_word long"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text).alias("text"))
    result = None
    for group in _passes(items, item_id, item_text):
        held = spark.sparkContext.broadcast((group, similarity, plan(similarity)))

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            b = Benchmark(*held.value)
            for batch in batches:
                found = leaks(b, list(batch["text"]))
                ids = batch["id"].tolist()
                out = [(ids[d], b.items[k][0], e, len(b.sequences[k]), at) for d, k, e, at in found]
                yield pd.DataFrame(out, columns=["id", "item_id", "edit_distance", "n_words", "first_word"]).rename(columns={"id": id_col})

        part = rows.mapInPandas(run, kind)
        result = part if result is None else result.union(part)
    return result


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                      similarity: float = SIMILARITY) -> DataFrame:
    """The documents that hold no item in the sense of find_leaks, with all their columns.

    Rows are judged one by one: null and word-less texts stay, and so does everything if there are no items; repeated
    rows stay or go together.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def clean(held):
        @F.pandas_udf("boolean")
        def column(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            b = Benchmark(*held.value)
            for texts in parts:
                bad = {d for d, *_ in leaks(b, list(texts))}
                yield pd.Series([k not in bad for k in range(len(texts))], dtype=bool)

        return column(whole_text(text))

    for group in _passes(items, item_id, item_text):
        docs = docs.where(clean(spark.sparkContext.broadcast((group, similarity, plan(similarity)))))
    return docs
