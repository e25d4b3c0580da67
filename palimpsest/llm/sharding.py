"""Shards of near equal bytes by sampled splitters.

Records are ordered by (text digest, id), so equal texts lie together and a group of any size can be cut inside. A
size-weighted sample of keys gives splitters at its quantiles; they cut the key space into many more ranges than
shards. The ranges' exact bytes are then counted, ranges that are overfull are subdivided by a denser sample of their
own keys, and a running sum inside each (bounded) range on top of the ranges' totals gives every record its exact byte
offset, hence its shard and its slot. Only digests, ids and sizes are shuffled, never texts.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import count as count_from

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches, whole_text

#: Ranges for small tables, rows of one range for large ones, sample keys for each splitter.
RANGES = 512
RANGE_ROWS = 200_000
OVERSAMPLE = 8
#: A range is overfull with so many times the bytes of an even one.
OVERFULL = 3.0
_KEY = ["digest", "doc_id", "uid"]


def _range_column(splitters: list[tuple]):
    """The number of splitters at or below a record's key."""

    @F.pandas_udf("int")
    def column(digest: pd.Series, doc_id: pd.Series, uid: pd.Series) -> pd.Series:
        keys = zip(digest, (-(2**63) if pd.isna(d) else int(d) for d in doc_id), uid, strict=True)
        return pd.Series([bisect_right(splitters, k) for k in keys], dtype="int32")

    return column(F.col("digest"), F.col("doc_id").cast("decimal(20,0)"), F.col("uid"))


def _quantiles(sample: list, n: int) -> list[tuple]:
    """n - 1 splitters or fewer at the weighted quantiles of (digest, doc_id, uid, weight) rows."""
    keys = sorted(((r[0], -(2**63) if r[1] is None else r[1], r[2]), r[3]) for r in sample)
    total, seen, cuts = sum(w for _, w in keys), 0.0, []
    for key, w in keys:
        if (len(cuts) + 1) * total / n <= seen:
            cuts.append(key)
        seen += w
    return sorted(set(cuts))


def _sampled(rows: DataFrame, bytes_for_each: float, seed: int) -> list:
    """Keys drawn with a chance in proportion to their size (1 for sizes above bytes_for_each), with what they stand for.

    Its expected length is the rows' bytes over bytes_for_each, a number the caller sets.
    """
    chance = F.least(F.lit(1.0), F.col("size") / F.lit(float(bytes_for_each)))
    draw = F.pmod(F.xxhash64(F.lit(seed), "uid", "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    weight = F.greatest(F.col("size").cast("double"), F.lit(float(bytes_for_each)))
    return [tuple(r) for r in rows.where(draw < chance).select(*_KEY, weight.alias("w")).collect()]


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text", ranges: int = RANGES) -> DataFrame:
    """One row per record: id, size, text_crc32, law "bytes", shard, slot, grown_shard (null), byte_offset.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). A record goes to the shard that holds its first byte's
    offset in key order, so shards differ from an even share by less than one record; slots count from 0 in each shard
    in key order. Equal texts are neighbours, and a group of them that lies across a shard's end is cut there: the law is
    on bytes, and at most one group is cut at each end. Null ids come first among equal texts; repeated rows are ordered by an
    arbitrary row number, which their equal columns make invisible. Empty tables give an empty result. Texts are read
    whole for their sizes and digests; other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(whole_text(text)) + 1).cast("long").alias("size"),
        F.crc32(whole_text(text).cast("binary")).alias("text_crc32"),
        F.md5(whole_text(text).cast("binary")).alias("digest"),
    ).withColumn("uid", F.monotonically_increasing_id())
    narrow = cut(narrow)
    count, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    n = max(ranges, -(-count // RANGE_ROWS), shards)
    even = max(1.0, total / n)
    splitters = _quantiles(_sampled(narrow, even / OVERSAMPLE, 1), n)
    for seed in count_from(1):
        ranged = narrow.withColumn("range", _range_column(splitters))
        sums = ranged.groupBy("range").agg(F.sum("size").alias("b"), F.max("size").alias("most"), F.count("*").alias("c")).collect()
        # One record alone may be larger than a range; what lies beside it is bounded.
        over = {r["range"]: r["b"] for r in sums if r["b"] - r["most"] > OVERFULL * even}
        if not over:
            break
        # Twice as dense every time, until it holds every record of a range; the overfull ranges' bytes bound the sample.
        found = _sampled(ranged.where(F.col("range").isin(list(over))), even / (4 << seed), seed)
        held = {k: [] for k in over}
        for key in found:
            held[bisect_right(splitters, (key[0], -(2**63) if key[1] is None else key[1], key[2]))].append(key)
        more = {s for k, keys in held.items() for s in _quantiles(keys, int(over[k] / even) + 1)}
        splitters = sorted({*splitters, *more})
    base, bytes_before, rows_before = [], 0, 0
    for r in sorted(sums, key=lambda r: r["range"]):
        base.append((r["range"], bytes_before, rows_before))
        bytes_before, rows_before = bytes_before + r["b"], rows_before + r["c"]
    # As many rows as ranges: bounded by the table's rows over RANGE_ROWS, so Spark broadcasts it while it is small.
    bases = spark.createDataFrame(base, "range int, bytes_before long, rows_before long")
    within = Window.partitionBy("range").orderBy("digest", F.col("doc_id").asc_nulls_first(), "uid")
    placed = (
        ranged.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(within))
        .join(bases, "range")
        .withColumn("byte_offset", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"byte_offset * {shards} div {max(1, total)}"), F.lit(shards - 1)).cast("int"))
        .withColumn("place", F.col("rows_before") + F.col("nth") - 1)
        .select("doc_id", "size", "text_crc32", "shard", "place", "byte_offset")
    )
    placed = cut(placed)
    heads = placed.groupBy("shard").agg(F.min("place").alias("head"))
    return placed.join(F.broadcast(heads), "shard").select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("place") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "byte_offset",
    )
