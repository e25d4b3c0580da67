"""Span corruption as a pure function of (seed, id): the same pairs on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.code import tokenize_java
from palimpsest.functions.text import tokens

# Mean noise spans and their length, and the actions' thresholds (delete, delete or insert).
SPANS = {"nl": (1.4, 3.0), "code": (1.9, 6.5)}
ACTIONS = {"nl": (0.07, 0.18), "code": (0.495, 0.71)}


def draw(*parts: Column) -> Column:
    """A number from 0 to below 1 out of the parts' MD5, the same in every engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / 4294967296.0


def tokenize_by_modality(c: Column, modality: str) -> Column:
    """Tokens of source code, none of a malformed one, or words between blanks."""
    return tokenize_java(c) if modality == "code" else tokens(c)


def composition(total: Column, parts: Column, seed: int, key: Column, what: str) -> Column:
    """array of ``parts`` positive lengths that sum to the total, every way to cut it equally likely: cuts are drawn one
    by one among the places that are left."""
    none = F.array().cast("array<int>")
    turns = F.when(parts > 1, F.sequence(F.lit(1), parts - 1)).otherwise(none)

    def one(cuts: Column, j: Column) -> Column:
        name = F.when(j > 1, F.concat_ws(":", F.lit(what), j.cast("string"))).otherwise(what)
        nth = F.floor(draw(F.lit(seed), key, name) * (total - j)).cast("int") + 1
        return F.array_sort(F.concat(cuts, F.array(F.aggregate(cuts, nth, lambda x, cut: F.when(cut <= x, x + 1).otherwise(x)))))

    cuts = F.aggregate(turns, none, one)
    return F.zip_with(F.concat(cuts, F.array(total)), F.concat(F.array(F.lit(0)), cuts), lambda hi, lo: hi - lo)


def segment_ids(lengths: Column) -> Column:
    """array of the number of its segment for each element of segments of these lengths."""
    return F.flatten(F.transform(lengths, lambda n, i: F.array_repeat(i, n)))


def noise_lengths(lines: DataFrame, mean_count: float, mean_length: float, seed: int = 20) -> DataFrame:
    """Adds noise (noise tokens in all), plain_runs and noise_runs (lengths; runs alternate, a plain one first). Rows that
    cannot be cut into that many runs go. lines: id, size."""
    t = lines.withColumn("noise", F.least(F.greatest(F.lit(round(mean_count * mean_length)), F.lit(1)), F.col("size") - 1)).where("size >= 2")
    t = t.withColumn("spans", F.greatest(F.lit(1), F.rint(F.col("noise") / mean_length)).cast("int"))
    t = t.where((F.col("noise") >= F.col("spans")) & (F.col("size") - F.col("noise") >= F.col("spans")))
    runs = lambda what, total: composition(total, F.col("spans"), seed, F.col("id"), what)
    return t.withColumn("plain_runs", runs("plain", F.col("size") - F.col("noise"))).withColumn("noise_runs", runs("noise", F.col("noise")))


def noise_mask(plain_runs: Column, noise_runs: Column) -> Column:
    """0/1 for each token: 1 for noise."""
    both = F.flatten(F.zip_with(plain_runs, noise_runs, lambda p, q: F.array(p, q)))
    return F.transform(segment_ids(both), lambda i: i % 2)


def corrupt(lines: DataFrame, modality: str = "nl", seed: int = 20, most: int = 512, spans: tuple[float, float] | None = None, words=tokens) -> DataFrame:
    """(id, noisy, clean, n_noise, mask, labels): lines of 2 to ``most`` tokens whose noise fits, with their spans
    deleted, replaced by a sentinel, or left out; the other lines go. Noise and other tokens alternate, noise comes last.

    lines: id and text. spans: mean number and length of noise spans, the modality's by default. words: the tokens of a
    text. A deleted span shows its tokens behind the sentinel, if it has more than one; an inserted one leaves nothing,
    and the token before it is labelled. labels: <KEEP>, <DELETE>, <REPLACE> or <INSERT> for each token of noisy.
    """
    # As a generator, so that the filter on the size does not make Spark split every text twice.
    t = lines.select("id", F.inline(F.array(F.struct(words(F.col("text")).alias("t"))))).withColumn("size", F.size("t")).where(F.col("size") <= most)
    t = noise_lengths(t, *(spans or SPANS[modality]), seed)
    low, high = ACTIONS[modality]
    before = lambda runs, k: F.aggregate(F.slice(runs, 1, k), F.lit(0), lambda a, n: a + n)
    keep = lambda n: F.array_repeat(F.lit("<KEEP>"), n)
    label = lambda x: F.array(F.lit(f"<{x}>"))

    def span(k: Column) -> Column:
        p, q = F.get("plain_runs", k), F.get("noise_runs", k)
        at = before(F.col("plain_runs"), k) + before(F.col("noise_runs"), k)
        plain, own = F.slice("t", at + 1, p), F.slice("t", at + p + 1, q)
        mark = F.array(F.concat(F.lit("<extra_id_"), k.cast("string"), F.lit(">")))
        u = draw(F.lit(seed), F.col("id"), F.lit("action"), k)
        shown = F.when(q > 1, own).otherwise(F.array().cast("array<string>"))
        out = F.when(u < low, F.concat(plain, mark, shown)).when(u < high, plain).otherwise(F.concat(plain, mark))
        labels = (
            F.when(u < low, F.concat(keep(p), label("DELETE"), keep(F.size(shown)))).when(u < high, F.concat(keep(p - 1), label("INSERT")))
            .otherwise(F.concat(keep(p), label("REPLACE")))
        )
        return F.struct(out.alias("out"), labels.alias("labels"))

    t = t.withColumn("x", F.transform(F.sequence(F.lit(0), F.col("spans") - 1), span))
    return t.select(
        "id", F.array_join(F.flatten("x.out"), " ").alias("noisy"), F.array_join("t", " ").alias("clean"), F.col("noise").alias("n_noise"),
        noise_mask(F.col("plain_runs"), F.col("noise_runs")).alias("mask"), F.flatten("x.labels").alias("labels"),
    )


def corrupt_code(lines: DataFrame, seed: int = 20, most: int = 512) -> DataFrame:
    """corrupt over the tokens of source code; malformed lines go."""
    return corrupt(lines, "code", seed, most, words=lambda c: tokenize_java(c, most))


def noise_spans(mask: Column) -> Column:
    """array of (start, end) of the runs of ones in a 0/1 mask, ends exclusive."""
    size = F.size(mask)
    at = lambda i: F.coalesce(F.get(mask, i), F.lit(0))
    places = F.when(size > 0, F.sequence(F.lit(0), size)).otherwise(F.array().cast("array<int>"))
    starts = F.filter(places, lambda i: (at(i) == 1) & (F.when(i > 0, at(F.greatest(i - 1, F.lit(0)))).otherwise(0) == 0))
    ends = F.filter(places, lambda i: (i > 0) & (at(i) == 0) & (at(F.greatest(i - 1, F.lit(0))) == 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))
