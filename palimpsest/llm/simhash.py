"""SimHash near-duplicate classes by a binary-trie self-join.

Fingerprints are the 64 majority bits over the XXH64 hashes of a text's 3-word shingles. Equal fingerprints are folded
first, so a group of copies of any size is one leaf. Two fingerprints that differ in at most three bits agree on one of
four 16-bit blocks; each block's value is the root of a trie over the other 48 bits, and the roots are the unit of
distribution. A root with more leaves than ``cap`` is split at its next bits: pairs of nodes there that differ in no more
bits than the budget allows are dealt out, and where one such node alone has more leaves than ``cap`` its leaves are split
by hash besides, so no task holds more than two parts of it. Inside a task the trie is traversed with pairs of nodes: the differing bits are added up, a pair is left
when its budget is spent, and also when all leaves below it are linked already, so dense groups do not cost their square.
What leaves a task is a forest (each leaf's smallest linked leaf), never the pairs. Components come from alternating
large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, small_batches, whole_text

SEED = 42
BITS = 64
BLOCK = 16
REST = BITS - BLOCK
#: Leaves of one trie that a task takes at most, times two for a pair of parts.
CAP = 16384
#: Bits by which a root is split at most.
SPLIT_BITS = 16
#: A fingerprint or class with more documents or fingerprints is joined on its own, by broadcast: there are at most
#: rows / HOT of them.
HOT = 1_000_000
#: Node pairs with no more leaf pairs than this are compared leaf by leaf.
LEAF_PAIRS = 64
#: Node pairs that are expanded at a time; the rest waits on the stack.
FRONT = 1 << 17
#: Shingles that are unpacked to bits at a time.
CHUNK = 1 << 14


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit fingerprint of a text; zero if it has no word.

    bytes.lower() changes A-Z only and bytes.split() splits at space and U+0009-U+000D only.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def column(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, column(whole_text(text)))


def _merge(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the classes of i and j; root[k] is the smallest member of k's class, before and after."""
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _leaf_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of the ranges [a0, a1) and [b0, b1)."""
    wide = b1 - b0
    size = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(size)), size)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a0[pair] + within // wide[pair], b0[pair] + within % wide[pair]


def trie_forest(group: np.ndarray, rest: np.ndarray, budget: int) -> np.ndarray:
    """For leaves sorted by (group, rest): the index of the smallest leaf linked to each within its group.

    group: small integers; rest: the REST low bits. Two leaves of a group are linked at ``budget`` or fewer
    differing bits.
    """
    n = len(rest)
    root = np.arange(n)
    key = (group.astype(np.uint64) << np.uint64(REST)) | rest.astype(np.uint64)
    edge = np.flatnonzero(np.diff(group)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [n]])
    many = hi - lo > 1
    lo, hi = lo[many], hi[many]
    stack = [(REST - 1, lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))]
    while stack:
        level, a0, a1, b0, b1, spent = stack.pop()
        if len(a0) > FRONT:
            stack.append((level, *(x[FRONT:] for x in (a0, a1, b0, b1, spent))))
            a0, a1, b0, b1, spent = (x[:FRONT] for x in (a0, a1, b0, b1, spent))
        turns = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
        done = (root[a0] == root[b0]) & (turns[a1 - 1] == turns[a0]) & (turns[b1 - 1] == turns[b0])
        keep = ~done
        a0, a1, b0, b1, spent = (x[keep] for x in (a0, a1, b0, b1, spent))
        few = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (level < 0)
        if few.any():
            i, j = _leaf_pairs(a0[few], a1[few], b0[few], b1[few])
            near = (i < j) & (np.bitwise_count(key[i] ^ key[j]) <= budget)
            _merge(root, i[near], j[near])
            a0, a1, b0, b1, spent = (x[~few] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit, above = np.uint64(1 << level), np.uint64(level + 1)
        am = np.clip(np.searchsorted(key, (key[a0] >> above << above) | bit), a0, a1)
        bm = np.clip(np.searchsorted(key, (key[b0] >> above << above) | bit), b0, b1)
        same = a0 == b0
        children = [
            (a0, am, b0, bm, spent, np.ones(len(a0), dtype=bool)),
            (am, a1, bm, b1, spent, np.ones(len(a0), dtype=bool)),
            (a0, am, bm, b1, spent + 1, np.ones(len(a0), dtype=bool)),
            (am, a1, b0, bm, spent + 1, ~same),
        ]
        parts = []
        for x0, x1, y0, y1, used, live in children:
            live = live & (x1 > x0) & (y1 > y0) & (used <= budget) & ~((x0 == y0) & (x1 - x0 == 1) & (y1 - y0 == 1))
            parts.append([x[live] for x in (x0, x1, y0, y1, used)])
        merged = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(merged[0]):
            stack.append((level - 1, *merged))
    return root


#: What names the leaves that a task compares with each other.
GROUP = ["block_no", "block", "lo", "hi", "i", "j"]


def _forests(batches: Iterator[pd.DataFrame], budget: int) -> Iterator[pd.DataFrame]:
    """The links of all tries of one partition, a bounded number of leaves at a time."""
    for held in _whole_groups(batches, 8 * CAP):
        held = held.sort_values([*GROUP, "rest"], ignore_index=True)
        group = np.concatenate([[0], np.cumsum((held[GROUP].diff().iloc[1:] != 0).any(axis=1).to_numpy())])
        fp = held["fp"].to_numpy()
        for at in range(0, int(group[-1]) + 1, 1 << BLOCK):
            here = (group >= at) & (group < at + (1 << BLOCK))
            own = fp[here]
            root = trie_forest(group[here] - at, held["rest"].to_numpy()[here], budget)
            linked = root != np.arange(len(root))
            if linked.any():
                yield pd.DataFrame({"a": own[linked], "b": own[root[linked]]})


def _whole_groups(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of about ``rows`` rows of a partition sorted by group, none of which cuts a group."""
    kept: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        kept.append(batch)
        count += len(batch)
        if count >= rows:
            frame = pd.concat(kept, ignore_index=True)
            last = (frame[GROUP] == frame[GROUP].iloc[-1]).all(axis=1)
            if not last.all():
                yield frame[~last]
                kept, count = [frame[last]], int(last.sum())
            else:
                kept = [frame]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def link_forest(prints: DataFrame, budget: int = 3, cap: int = CAP) -> DataFrame:
    """(a, b): a forest that joins all of the distinct fingerprints ``prints.fp`` at ``budget`` or fewer differing bits."""
    if budget > 3:
        raise ValueError("four blocks find at most three differing bits")
    fp = F.col("fp")

    def turned(k: int) -> Column:
        return F.shiftleft(fp, BLOCK * k).bitwiseOR(F.shiftrightunsigned(fp, BITS - BLOCK * k)) if k else fp

    tries = [
        F.struct(
            F.lit(k).alias("block_no"),
            F.shiftrightunsigned(turned(k), REST).cast("int").alias("block"),
            turned(k).bitwiseAND(F.lit((1 << REST) - 1)).alias("rest"),
        )
        for k in range(BITS // BLOCK)
    ]
    leaves = prints.select("fp", F.explode(F.array(*tries)).alias("x")).select("fp", "x.*")
    names = ["block_no", "block"]
    # At most four times 65,536 roots, so the table of hot ones can be sent to all tasks.
    hot = cut(leaves.groupBy(*names).count().where(F.col("count") > cap))
    cell = F.struct(*[F.lit(0).cast(t).alias(x) for x, t in (("lo", "long"), ("hi", "long"), ("i", "int"), ("j", "int"))])
    if hot.isEmpty():
        dealt = leaves.withColumn("c", cell)
    else:
        bits = F.least(F.ceil(F.log2(F.col("count") / cap)), F.lit(SPLIT_BITS)).cast("int")
        split = leaves.join(F.broadcast(hot.select(*names, bits.alias("bits"))), names)
        split = split.withColumn("node", F.expr(f"shiftrightunsigned(rest, {REST} - bits)"))
        parts = split.groupBy(*names, "node").count().groupBy(*names).agg(F.ceil(F.max("count") / cap).cast("int").alias("parts"))
        split = split.join(F.broadcast(parts), names).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        other = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.shiftleft(F.lit(1).cast("long"), SPLIT_BITS) - 1), lambda m: F.bit_count(m) <= budget))
        masks = prints.sparkSession.range(1).select(other.alias("mask"))  # some seven hundred
        split = split.join(F.broadcast(masks), F.col("mask") < F.expr("shiftleft(1L, bits)"))
        node = F.col("node").bitwiseXOR(F.col("mask"))
        grid = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(
            F.least("node", node).alias("lo"), F.greatest("node", node).alias("hi"), F.least(x, F.col("part")).alias("i"), F.greatest(x, F.col("part")).alias("j"),
        ))
        rest = leaves.join(F.broadcast(hot), names, "left_anti").withColumn("c", cell)
        dealt = rest.unionByName(split.select("fp", *names, "rest", F.explode(grid).alias("c")))
    dealt = dealt.select("fp", *names, "rest", "c.*").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInPandas(lambda batches: _forests(batches, budget), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node reaches, by large-star and small-star rounds.

    Every round is checkpointed; nothing but a count and a hash sum comes to the driver. Self-links and repeated
    links do no harm. A star's centre is a hot key of the inner joins; its rows are short, and Spark's adaptive execution
    splits them.
    """
    edges = cut(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        ends = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(lower, "a").select(F.explode(ends).alias("e"))
        edges = cut(small.select("e.*").where(F.col("a") > F.col("b")).distinct())


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 3, cap: int = CAP) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id, class_size.

    component_id is the smallest id of all documents reachable over links (null ids are not counted; a class of
    null ids only has null). class_size counts the class's documents. Null and word-less texts have fingerprint zero and
    are linked like any other; repeated rows stay; an empty table gives an empty result; texts are read whole, and
    columns other than the two named are not looked at.
    """
    return _classed_rows(docs, id_col, text, budget, cap).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_size"
    )


def _spread_join(rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with ``few``, which has a row for each key and how many rows have it, n. Keys of more than
    HOT rows do not gather in one task: they are at most rows / HOT, and are sent to the rows instead."""
    hot = few.where(F.col("n") > HOT)
    if hot.isEmpty():
        return rows.join(few, key)
    hot = F.broadcast(hot)
    return rows.join(few.where(F.col("n") <= HOT), key).unionByName(rows.join(hot, key))


def _row_key(id_col: str, text: str) -> list[Column]:
    """Two hashes of id and text, which tell apart all rows but repeated ones."""
    return [F.xxhash64(id_col, text).alias("_key"), F.hash(id_col, text).alias("_check")]


def _classed_rows(docs: DataFrame, id_col: str, text: str, budget: int, cap: int) -> DataFrame:
    """(id, _key, _check, fp, root, component_id, class_size), a row per document; root names the class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *_row_key(id_col, text))
    base = cut(with_fingerprint(rows, "text", "fp").select("id", "_key", "_check", "fp"))
    prints = cut(base.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("documents")))
    known = components(link_forest(prints.select("fp"), budget, cap))
    classed = cut(prints.join(known, prints["fp"] == known["node"], "left").select("fp", "least_id", "documents", F.coalesce("root", "fp").alias("root")))
    tops = cut(classed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("documents").alias("class_size"), F.count("*").alias("n")))
    named = _spread_join(classed.select("fp", "root", "documents"), tops, "root").drop("n")
    return _spread_join(base, named.withColumnRenamed("documents", "n"), "fp").drop("n")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", budget: int = 3) -> DataFrame:
    """Keeps one document of each class, the one with the smallest id, whole and with all its columns, of any name.

    Rows are told apart by id and text: a repeated row stays once, and an id with two texts is two documents. Of rows that
    share id and text but not the other columns, the one with the least hash of the whole row, written as JSON, stays. Of
    the documents of a class that have no id, one stays besides.
    """
    rows = _classed_rows(docs, id_col, text, budget, CAP)
    least = rows.groupBy("root", F.isnull("id").alias("no_id")).agg(F.min(F.struct("id", "_key", "_check")).alias("r"))
    # A row's own columns travel as one, so that no name of theirs can clash.
    held = docs.select(F.struct("*").alias("row"), *_row_key(id_col, text))
    kept = held.join(least.select("r._key", "r._check"), ["_key", "_check"], "left_semi")
    return kept.groupBy("_key", "_check").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
