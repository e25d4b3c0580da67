"""Language identification by mixture inference over character n-grams.

Training counts hashed character trigrams for each language over every learning row. A document is read as a mixture:
each of its words has a likelihood under each language (the product of its trigrams'), expectation-maximisation
estimates the languages' proportions until its likelihood is as good as the best, and the set of languages is chosen by
penalised likelihood among the nested sets of the most frequent ones. The prediction is the language with the largest
proportion.

With many languages a document is estimated over its likeliest few. The likelihood is concave, so its slope towards each
language left out bounds what that one could add; languages come in until none could add more than the tolerance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import small_batches, whole_text

BUCKETS = 1 << 16
SMOOTH = 0.5
#: Estimation ends when the log likelihood is proven to be no further than this from the best.
TOLERANCE = 0.1
#: Languages that a model is made for; a column with more is an error, since the model's size goes with them.
MAX_LANGUAGES = 512
PENALTY = 1.0
#: Languages that a document's estimation begins with, and that come in at a time.
ACTIVE = 8
#: Cells of trigrams times languages that are held at a time; texts are taken in slices of so many.
CELLS = 1 << 22
UNKNOWN = "und"

_LETTER = None


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, words, texts): for each trigram around a letter its bucket, and the numbers of its word and text.

    Case is folded; whatever is no letter ends a word. Words are numbered through all texts.
    """
    joined = " " + " ".join(t.lower() for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter)
    mixed = code[at - 1] * np.uint64(0x9E3779B97F4A7C15) + code[at] * np.uint64(0xC2B2AE3D27D4EB4F) + code[at + 1] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    bucket = (mixed * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    word = np.cumsum(~letter)[at]
    starts = np.cumsum([1] + [len(t.lower()) + 1 for t in texts])
    return bucket, word, np.searchsorted(starts, at, side="right") - 1


def count_trigrams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all rows with a language."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, own in batch.groupby("lang"):
                bucket, _, _ = trigrams(list(own["text"]))
                held[name] = held.get(name, 0) + np.bincount(bucket, minlength=BUCKETS)
        for name, counts in held.items():
            found = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": name, "bucket": found.astype(np.int32), "n": counts[found]})

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), whole_text(text).alias("text"))
    return rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihood of each bucket). Counts cover all rows; the model has BUCKETS figures a language."""
    n = docs.where(F.col(lang).isNotNull()).select(lang).distinct().limit(max_languages + 1).count()
    if n > max_languages:
        raise ValueError(f"more than {max_languages} languages in column {lang}")
    def column(own: pd.DataFrame) -> pd.DataFrame:
        counts = np.full(BUCKETS, SMOOTH)
        counts[own["bucket"]] += own["n"]
        return pd.DataFrame({"lang": own["lang"][:1], "logs": [np.log(counts / counts.sum()).astype(np.float32).tobytes()]})

    # A language's counts are at most BUCKETS rows; its column of the model comes to the driver as 4 * BUCKETS bytes.
    columns = count_trigrams(docs, lang, text).groupBy("lang").applyInPandas(column, "lang string, logs binary")
    found = {r["lang"]: r["logs"] for r in columns.toLocalIterator()}
    names, table = sorted(found), np.empty((BUCKETS, len(found)), dtype=np.float32)
    for k, name in enumerate(names):
        table[:, k] = np.frombuffer(found.pop(name), np.float32)
    return names, table


def _mixture(like: np.ndarray, n: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(proportions, log likelihood, how far it is from the best at most) of each document.

    like: each word's likelihood under each language; n: each document's words; allowed: the languages of its set. The
    likelihood is concave in the proportions, so its slope bounds what is still to gain. Documents leave as they are done.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    value, gap = np.zeros(len(n)), np.zeros(len(n))
    live, own, size, now, may = np.arange(len(n)), like, n, share.copy(), allowed
    while len(live):
        first, of = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        mix = np.maximum((own * now[of]).sum(axis=1), 1e-300)
        slope = np.add.reduceat(own / mix[:, None], first, axis=0) * may
        left = np.maximum(slope.max(axis=1) - size, 0.0)
        done = left <= TOLERANCE
        if done.any():
            at = live[done]
            share[at], gap[at] = now[done], left[done]
            value[at] = np.add.reduceat(np.log(mix), first)[done]
            keep = ~done
            own, live, size, now, may, slope = own[keep[of]], live[keep], size[keep], now[keep], may[keep], slope[keep]
        now = now * slope / size[:, None]
    return share, value, gap


def _full_mixture(like: np.ndarray, n: np.ndarray, likeliest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_mixture`` gives with all languages allowed. likeliest: each document's languages, the likeliest first."""
    langs = like.shape[1]
    if langs <= 2 * ACTIVE:
        return _mixture(like, n, np.ones((len(n), langs)))
    share, value, gap = np.zeros((len(n), langs)), np.zeros(len(n)), np.zeros(len(n))
    live, own, size, active = np.arange(len(n)), like, n, np.sort(likeliest[:, :ACTIVE], axis=1)
    while len(live):
        of, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
        part, likely, _ = _mixture(np.take_along_axis(own, active[of], axis=1), size, np.ones(active.shape))
        mix = np.maximum((np.take_along_axis(own, active[of], axis=1) * part[of]).sum(axis=1), 1e-300)
        slope = np.add.reduceat(own / mix[:, None], first, axis=0)
        left = np.maximum(slope.max(axis=1) - size, 0.0)
        done = (left <= TOLERANCE) | (active.shape[1] == langs)
        at = live[done]
        share[at[:, None], active[done]], value[at], gap[at] = part[done], likely[done], left[done]
        keep = ~done
        # Those come in whose slope is steepest, beside the ones that are there.
        np.put_along_axis(slope, active, np.inf, axis=1)
        more = min(langs, active.shape[1] + ACTIVE)
        own, live, size = own[keep[of]], live[keep], size[keep]
        active = np.sort(np.argpartition(-slope[keep], more - 1, axis=1)[:, :more], axis=1)
    return share, value, gap


def _infer_slice(bucket: np.ndarray, word: np.ndarray, text: np.ndarray, log_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with a letter, their proportions) of the trigrams of some texts."""
    langs = log_table.shape[1]
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    ends = np.append(heads, len(word))
    # A long text's words are looked up some at a time, so that only words times languages are held of it.
    logs, at = np.empty((len(heads), langs)), 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + CELLS // langs, side="right")) - 1)
        logs[at:to] = np.add.reduceat(log_table[bucket[ends[at] : ends[to]]], heads[at:to] - heads[at], axis=0)
        at = to
    logs -= logs.max(axis=1, keepdims=True)
    like = np.exp(logs)
    of = text[heads]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    n = np.diff(np.append(first, len(of)))
    single = np.add.reduceat(np.maximum(logs, np.log(1e-300)), first, axis=0)
    share, likely, gap = _full_mixture(like, n, np.argsort(-single, axis=1, kind="stable"))
    top = single.argmax(axis=1)
    best, chosen = single[np.arange(len(first)), top], np.eye(langs)[top]
    cost = PENALTY * (1 + np.log(n) / 2)
    likeliest = np.argsort(-share, axis=1, kind="stable")
    for k in range(2, langs + 1):
        open_ = np.flatnonzero(likely + gap - (k - 1) * cost > best)
        if not len(open_):
            break
        inside = np.repeat(np.isin(np.arange(len(first)), open_), n)
        held = np.sort(likeliest[open_, :k], axis=1)
        part, value, _ = _mixture(np.take_along_axis(like[inside], np.repeat(held, n[open_], axis=0), axis=1), n[open_], np.ones(held.shape))
        value = value - (k - 1) * cost[open_]
        better = value > best[open_]
        best[open_] = np.where(better, value, best[open_])
        own = np.zeros((len(open_), langs))
        np.put_along_axis(own, held, part, axis=1)
        chosen[open_[better]] = own[better]
    return of[first], chosen


def infer(texts: list[str], log_table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, proportions): whether a text has a letter, and its languages' proportions after the set's choice.

    One language is compared with the mixture of all first: the best likelihood of the latter bounds those of the sets
    between, so these are estimated only for documents and sizes by which they could still win. Of languages with equal
    shares the first in alphabetical order counts. Texts are taken in slices of ``CELLS`` trigrams times languages, and
    of a text beyond that words times languages are held.
    """
    langs = log_table.shape[1]
    known, out = np.zeros(len(texts), dtype=bool), np.zeros((len(texts), langs))
    bucket, word, text = trigrams(texts)
    at = 0
    while langs and at < len(bucket):
        to = int(np.searchsorted(text, text[min(len(text) - 1, at + CELLS // langs)]))
        if to <= at:  # one text fills the slice
            to = int(np.searchsorted(text, text[at], side="right"))
        elif at + CELLS // langs >= len(text):
            to = len(text)
        rows, shares = _infer_slice(bucket[at:to], word[at:to], text[at:to], log_table)
        known[rows], out[rows] = True, shares
        at = to
    return known, out


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """Adds lang_pred, score (its proportion) and lang_mix (the set's languages and proportions).

    Null texts and texts without a letter get "und", 0 and no languages, as do all texts if nothing was learned. Columns
    of these three names are replaced, all others stay; repeated rows get equal results, an empty table stays empty.
    Texts are read whole, in time in proportion to their length.
    """
    names, held = model[0], docs.sparkSession.sparkContext.broadcast(model[1])
    small_batches(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, lang_mix array<struct<lang:string,share:double>>")
    def column(texts: pd.Series) -> pd.DataFrame:
        known, share = infer(list(texts), held.value)
        rows = []
        for ok, own in zip(known, share, strict=True):
            if not ok:
                rows.append((UNKNOWN, 0.0, []))
                continue
            mix = [{"lang": names[k], "share": float(own[k])} for k in np.argsort(-own, kind="stable") if own[k] > 0]
            rows.append((mix[0]["lang"], min(1.0, mix[0]["share"]), mix))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "lang_mix"])

    # The rows' own columns travel as one, so that no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), column(whole_text(text)).alias("found"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "lang_mix")]
    return rows.select(*kept, "found.*")


def identify(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text") -> DataFrame:
    """Learns from the rows where ``learn`` holds and predicts all rows."""
    return predict(docs, fit(docs.where(learn), lang, text), text)
