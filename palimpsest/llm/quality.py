"""Quality classification: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits and single other signs; a word that follows itself is read as one word for all
repeats. Features are their hashed 1- and 2-grams. A score is a sparse dot product. Training runs in one executor task
over a bounded sample; features are made and scores are given where the rows are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

BITS = 18
#: Expected rows of the training sample; labels beyond it are drawn by a hash of the id.
MAX_TRAIN = 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]")
#: Stands for a word that follows itself.
_AGAIN = b"=="


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values): distinct buckets in order, values of Euclidean length 1; both empty for a text without words."""
    found = _WORD.findall(text.encode("utf-8", "surrogatepass"))
    if not found:
        return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32)
    words = [_AGAIN if w == before else w for w, before in zip(found, [b"", *found], strict=False)]
    w = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = np.concatenate([w, w[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + w[1:]])
    mixed ^= mixed >> np.uint64(31)
    bucket, count = np.unique((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS), return_counts=True)
    value = np.log1p(count)
    return bucket.astype(np.int32), (value / np.sqrt((value**2).sum())).astype(np.float32)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the 2^BITS buckets and, last, the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= L1, 0.0, (np.sign(own) * L1 - own) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    prepared = [(np.append(i, size - 1), np.append(v, 1.0), y) for i, v, y in rows]
    for _ in range(epochs):
        for at, value, y in prepared:
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(np.arange(size)).astype(np.float32)


def labelled_sample(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of at most ``max_rows`` labelled ids in expectation, drawn by hash; repeated labels are averaged and
    rounded, null ids and labels left out."""
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("id"))
    one = one.agg(F.round(F.avg(label)).cast("int").alias("y"))
    n = one.count()
    if n > max_rows:
        one = one.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    return one


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN, id_col: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights learned from the labelled rows; all zero if there are none."""
    small_batches(docs.sparkSession)
    # Bounded by max_rows, a parameter.
    sample = F.broadcast(labelled_sample(labels, label, max_rows, id_col))

    @F.pandas_udf("i binary, v binary")
    def column(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tuple(x.tobytes() for x in features(t)) for t in texts], columns=["i", "v"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text).alias("text")).join(sample, "id")
    rows = rows.select("id", "y", column("text").alias("f")).select("id", "y", "f.*")

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [*batches]
        if not parts:
            return
        held = pd.concat(parts, ignore_index=True)
        key = [zlib.crc32(f"{i}".encode()) for i in held["id"]]
        held = held.assign(key=key).sort_values(["key", "id", "i"], ignore_index=True)
        own = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(held["i"], held["v"], held["y"], strict=True)]
        yield pd.DataFrame({"w": [ftrl(own).tobytes()]})

    found = rows.repartition(1).mapInPandas(train, "w binary")
    first = found.first()
    return np.frombuffer(first["w"], np.float32) if first else np.zeros((1 << BITS) + 1, dtype=np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the probability of label 1; null, empty and blank texts get the bias's. A column named as ``out`` is replaced,
    all others stay; all rows stay, repeated ones with equal scores; texts are read whole, in time in proportion to their
    length."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def column(texts: pd.Series) -> pd.Series:
        w = held.value
        found = []
        for t in texts:
            i, v = features(t)
            found.append(float(w[i] @ v + w[-1]))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(found), -35, 35))))

    return docs.withColumn(out, column(whole_text(text)))
