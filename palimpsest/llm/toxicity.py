"""Toxicity: embeddings of subword bags, averaged, into a linear softmax, both trained together in numpy.

A word's vector is the mean of its hashed character n-grams' vectors (with the whole word's), so an unseen misspelling
shares most of a known word's vectors. A window's vector is the mean of its words'; a linear softmax maps it to two
classes, and a document's score is that of its most toxic window, so that neither long texts dilute a passage nor
whole texts have to be cut. Labels are on documents, so training alternates between choosing each document's windows
with the present model and fitting the model to them; the first choice goes by how often the documents of either class
hold the windows' n-grams. An n-gram that few documents hold has no vector.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text
from palimpsest.llm.quality import labelled_sample

BUCKETS = 1 << 16
SHORTEST, LONGEST = 3, 5
DIMS = 4
WINDOW, STRIDE = 6, 3
#: Expected sample rows of each class.
MAX_TOXIC, MAX_CLEAN = 1000, 2500
#: Documents that hold an n-gram with a vector, at least; by how many documents a first odds ratio is drawn to none.
LEAST_DOCS, SHRINK = 3, 3.0
ROUNDS, STEPS, RATE, DECAY = 5, 30, 0.05, 1e-2

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """The text's words in lower case; a word that follows itself counts once, so that drumming on it weighs nothing."""
    words = _WORD.findall(text.lower())
    return [w for w, before in zip(words, ["", *words], strict=False) if w != before]


def numbered(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of the word at each position, words of each text)."""
    number: dict[str, int] = {}
    at, n = [], []
    for text in texts:
        own = words_of(text)
        n.append(len(own))
        at += [number.setdefault(w, len(number)) for w in own]
    return list(number), np.array(at, dtype=np.int64), np.array(n, dtype=np.int64)


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word numbers) of the marked words' n-grams and of the words themselves, in no order."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.array([len(w) + 2 for w in words])
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    mixed = (code + np.uint64(1)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
    mixed ^= mixed >> np.uint64(29)
    hashes = [np.add.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), np.cumsum(size) - size)]
    numbers = [np.arange(len(words))]
    rolled = code
    for n in range(2, LONGEST + 1):
        rolled = rolled[:-1] * np.uint64(0x100000001B3) + code[n - 1 :]
        if n >= SHORTEST:
            inside = of[: len(rolled)] == of[n - 1 :]
            hashes.append(rolled[inside] + np.uint64(n))
            numbers.append(of[: len(rolled)][inside])
    found = np.concatenate(hashes)
    found ^= found >> np.uint64(32)
    return ((found * np.uint64(0x94D049BB133111EB)) >> np.uint64(48)).astype(np.int64) % BUCKETS, np.concatenate(numbers)


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words; they cover all words."""
    start = np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)
    return start, np.minimum(start + WINDOW, n)


def _documents_with(counts: np.ndarray, token: np.ndarray, flat: np.ndarray, subs: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket how many documents hold it, and how many toxic ones."""
    first, at = np.cumsum(subs) - subs, np.cumsum(counts) - counts
    held = np.zeros((2, BUCKETS), dtype=np.int64)
    for d, (lo, n) in enumerate(zip(at, counts, strict=True)):
        own = np.unique(token[lo : lo + n])
        m = subs[own]
        inside = np.unique(flat[np.repeat(first[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())])
        held[0, inside] += 1
        held[1, inside] += int(y[d] == 1)
    return held[0], held[1]


def train(texts: list[str], toxic: list[int], seed: int = 1) -> tuple[np.ndarray, float]:
    """(a figure for each subword bucket, bias): the two classes' difference, to which the trained model reduces."""
    rng = np.random.default_rng(seed)
    words, token, counts = numbered(texts)
    y = np.asarray(toxic)
    if not len(token) or y.min() == y.max():
        return np.zeros(BUCKETS, dtype=np.float32), -20.0 if not len(y) or y.max() < 1 else 20.0
    starts, ends, doc = [], [], []
    for d, (n, before) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)):
        if n:
            s, e = windows(n)
            starts.append(s + before)
            ends.append(e + before)
            doc.append(np.full(len(s), d))
    bucket, of = subwords(words)
    order = np.argsort(of, kind="stable")
    flat, subs = bucket[order], np.bincount(of, minlength=len(words))
    first = np.cumsum(subs) - subs
    start, end, doc = np.concatenate(starts), np.concatenate(ends), np.concatenate(doc)
    size = end - start
    held, toxic_held = _documents_with(counts, token, flat, subs, y)
    common = held >= LEAST_DOCS
    table = rng.normal(0, 0.1, (BUCKETS, DIMS)) * common[:, None]
    soft = rng.normal(0, 0.1, (DIMS, 2))
    bias = np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, soft, bias)]
    step = 0

    def window_scores(figure: np.ndarray) -> np.ndarray:
        word = np.add.reduceat(figure[flat], first) / subs
        total = np.concatenate([[0], np.cumsum(word[token])])
        return (total[end] - total[start]) / size

    odds = np.log((toxic_held + 0.5) / ((y == 1).sum() + 1)) - np.log((held - toxic_held + 0.5) / ((y == 0).sum() + 1))
    for turn in range(ROUNDS):
        value = window_scores(table @ (soft[:, 1] - soft[:, 0]) if turn else odds * common * held / (held + SHRINK))
        order = np.lexsort((-value, doc))
        nth = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        most = np.where(y[doc[order]] == 1, 3 if turn < 2 else 1, 4)
        pick = order[nth < most]
        extra = rng.choice(len(doc), min(len(doc), 2000), replace=False)
        pick = np.unique(np.concatenate([pick, extra[y[doc[extra]] == 0]]))
        target = y[doc[pick]]
        balance = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
        n = size[pick]
        at = np.repeat(start[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        used, local = np.unique(token[at], return_inverse=True)
        m = subs[used]
        sub_at = np.repeat(first[used] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        rows, sub = np.unique(flat[sub_at], return_inverse=True)
        head_n, head_m = np.cumsum(n) - n, np.cumsum(m) - m
        of_n, of_m = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)
        for _ in range(STEPS):
            step += 1
            word = np.add.reduceat(table[rows][sub], head_m, axis=0) / m[:, None]
            mean = np.add.reduceat(word[local], head_n, axis=0) / n[:, None]
            logit = mean @ soft + bias
            p = np.exp(logit - logit.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(p)), target] -= 1
            p *= balance[:, None] * 1000
            d_mean = (p @ soft.T) / n[:, None]
            d_word = np.stack([np.bincount(local, d_mean[of_n, k], len(used)) for k in range(DIMS)], axis=1) / m[:, None]
            d_rows = np.stack([np.bincount(sub, d_word[of_m, k], len(rows)) for k in range(DIMS)], axis=1) * common[rows][:, None]
            for p_, g, (a, b), own in ((table, d_rows, state[0], rows), (soft, mean.T @ p, state[1], slice(None)), (bias, p.sum(axis=0), state[2], slice(None))):
                g = g / 1000 + DECAY * p_[own] * (p_ is not bias) / 1000
                a[own] = 0.9 * a[own] + 0.1 * g
                b[own] = 0.99 * b[own] + 0.01 * g * g
                p_[own] -= RATE * (a[own] / (1 - 0.9**step)) / (np.sqrt(b[own] / (1 - 0.99**step)) + 1e-9)
    return (table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, id_col: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """The model learned from a sample bounded for each class; without labels of both classes, a constant."""
    small_batches(docs.sparkSession)
    parts = [labelled_sample(labels.where(F.col(label) == v), label, n, id_col) for v, n in ((1, max_toxic), (0, max_clean))]
    # Bounded by max_toxic and max_clean, parameters. An id labelled both ways counts as toxic.
    sample = F.broadcast(parts[0].union(parts[1]).groupBy("id").agg(F.max("y").alias("y")))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text")).join(sample, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [*batches]
        if not own:
            return
        held = pd.concat(own, ignore_index=True).sort_values(["id", "text"], ignore_index=True)
        figure, bias = train(list(held["text"]), list(held["y"]))
        yield pd.DataFrame({"w": [figure.tobytes()], "b": [bias]})

    first = rows.repartition(1).mapInPandas(run, "w binary, b double").first()
    return (np.frombuffer(first["w"], np.float32), first["b"]) if first else (np.zeros(BUCKETS, dtype=np.float32), -20.0)


def probabilities(texts: list[str], figure: np.ndarray, bias: float) -> np.ndarray:
    """Each text's score."""
    words, token, counts = numbered(texts)
    bucket, of = subwords(words)
    word = np.bincount(of, figure[bucket], len(words)) / np.maximum(1, np.bincount(of, minlength=len(words)))
    best = np.zeros(len(texts))
    total = np.concatenate([[0], np.cumsum(word[token])]) if len(token) else np.zeros(1)
    for k, (n, before) in enumerate(zip(counts, np.cumsum(counts) - counts, strict=True)):
        if n:
            start, end = windows(n)
            best[k] = ((total[before + end] - total[before + start]) / (end - start)).max()
    return 1 / (1 + np.exp(-np.clip(best + bias, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability that the text is toxic; null, empty and word-less texts get the bias's. A column named as
    ``out`` is replaced, all others stay; all rows stay, repeated ones with equal scores; texts are read whole, in time in
    proportion to their length."""
    held, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series(probabilities(list(texts), held.value, bias))

    return docs.withColumn(out, column(whole_text(text)))
