"""The code metric's parts over the n-gram table and over supplied tables of subtrees and data-flow edges."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.code import JAVA_KEYWORDS
from palimpsest.functions.text import tokens
from palimpsest.operators import gram_sums, metrics
from palimpsest.operators.ngrams import dealt
from palimpsest.sources.shared import cut, small_batches, written

#: Weight of a token that is no keyword; a keyword weighs 1.
PLAIN_WEIGHT = 0.2
PARTS = ("ngram", "weighted", "syntax", "dataflow")


def recall_stats(rows: DataFrame, keywords: tuple[str, ...] = JAVA_KEYWORDS) -> DataFrame:
    """For each example: hlen, rlen, num and den by order for precision, and rnum and rden for recall, whose first
    order weighs keywords above other tokens. rows: example_id, ref, pred."""
    whole, parts = ["hlen", "rlen", *[f"num{n}" for n in metrics.N]], [f"{k}{n}" for k in ("rnum", "rden") for n in metrics.N]

    def summing(texts, found, rows):
        out = {}
        for g in found:
            r, h = g.counts(2).T
            same = np.minimum(h, r)
            # A word's weight; longer grams have none.
            w = np.where(np.isin(g.last, np.flatnonzero(pc.is_in(g.words, pa.array(keywords, pa.string())).to_numpy(zero_copy_only=False))), 1.0, PLAIN_WEIGHT) if g.n == 1 else 1.0
            if g.n == 1:
                out |= {"hlen": gram_sums.by_row(g, rows, h), "rlen": gram_sums.by_row(g, rows, r)}
            out |= {f"num{g.n}": gram_sums.by_row(g, rows, same), f"rnum{g.n}": gram_sums.by_row(g, rows, same * w), f"rden{g.n}": gram_sums.by_row(g, rows, r * w)}
        return out

    schema = ", ".join([*[f"{c} long" for c in whole], *[f"{c} double" for c in parts]])
    t = gram_sums.side_sums(rows.where(F.coalesce("ref", "pred").isNotNull()), [tokens(F.col("ref")), tokens(F.col("pred"))], schema, summing, metrics.ORDERS)
    return t.select("example_id", *[F.col(f"sums.{c}").cast("int").alias(c) if c in ("hlen", "rlen") else F.col(f"sums.{c}").alias(c) for c in [*whole, *parts]])


def corpus_sums(stats: DataFrame) -> DataFrame:
    """One row of the statistics' sums, every denominator at least 1 in each example."""
    dens = [F.greatest(F.col("hlen") - (n - 1), F.lit(1)) for n in metrics.N]
    return stats.agg(
        F.count("*").alias("examples"), F.sum("hlen").alias("hlen"), F.sum("rlen").alias("rlen"),
        *[F.sum(f"num{n}").alias(f"num{n}") for n in metrics.N], *[F.sum(d).alias(f"den{n}") for n, d in zip(metrics.N, dens, strict=True)],
        *[F.sum(f"rnum{n}").alias(f"rnum{n}") for n in metrics.N],
        *[F.sum(F.greatest(F.col(f"rden{n}"), F.lit(1.0))).alias(f"rden{n}") for n in metrics.N],
    )


def _list(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in metrics.N]


def weighted_value(method: str, ref_len: str, examples: Column) -> Column:
    """Recall-side BLEU out of the sums. ref_len "pair" takes 2 tokens for a reference, as published figures do, so
    that the brevity penalty rarely bites; "true" takes its length."""
    if ref_len not in ("pair", "true"):
        raise ValueError(ref_len)
    if method not in ("method1", "method2"):
        raise ValueError(method)
    rlen = F.col("rlen") if ref_len == "true" else 2 * examples
    return metrics.bleu(method, _list("rnum"), _list("rden"), F.col("hlen"), rlen)


def weighted_corpus_bleu(stats: DataFrame, method: str = "method1", ref_len: str = "pair") -> DataFrame:
    value = weighted_value(method, ref_len, F.col("examples"))
    return corpus_sums(stats).select("examples", F.round(value, 6).alias("weighted_bleu"))


def syntax_counts(subtrees: DataFrame) -> DataFrame:
    """(example_id, s_match, s_all): reference subtrees, and those that the hypothesis holds anywhere.

    subtrees: example_id, side ("ref" or "hyp"), sexp. Both sides' counts come from one grouping.
    """
    side = lambda s: F.count(F.when(F.col("side") == s, 1))
    # Both groupings keep this partitioning.
    counts = dealt(subtrees, "example_id").groupBy("example_id", "sexp").agg(side("ref").alias("r"), side("hyp").alias("h"))
    return counts.groupBy("example_id").agg(F.sum(F.when(F.col("h") > 0, F.col("r")).otherwise(0)).alias("s_match"), F.sum("r").alias("s_all"))


TREE = ["example_id", "side"]


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    """Equality of columns, null included, with those of b under the same name and a low line."""
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[f"{c}_"]) for c in names])


def _marked(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """The right side of a join with _same, which is never broadcast: its file's size says little of its rows' size."""
    return df.select(*[F.col(c).alias(f"{c}_") for c in names], *more).hint("merge")


def tree_paths(nodes: DataFrame) -> DataFrame:
    """(example_id, side, node, kind, path): the places, among their siblings, of a node and of those around it, from the
    root down.

    nodes: example_id, side, node, parent, ordinal, kind; node is unique on a side, ordinals may have gaps. A node whose
    parent is null or not there is a root, and roots are siblings. Every round joins each node with the one that it has
    reached so far, so a depth of d takes log d rounds. Parents that form a circle are an error.
    """
    there = _marked(nodes.select(*TREE, "node"), [*TREE, "node"])
    known = _same(nodes, there, TREE) & (nodes["parent"] == there["node_"])
    own = nodes.join(there, known, "left").select(*[nodes[c] for c in (*TREE, "node", "kind", "ordinal")], F.col("node_").alias("up"))
    place = F.row_number().over(Window.partitionBy(*TREE, "up").orderBy("ordinal", "node"))
    now = written(own.select(*TREE, "node", "kind", "up", F.array(place).alias("path")))
    # Two times as far each round: no path is longer than its tree has nodes.
    largest = now.groupBy(*TREE).count().agg(F.max("count")).first()[0] or 0
    for _ in range(largest.bit_length() + 1):
        if now.where("up is not null").isEmpty():
            return now.drop("up")
        over = _marked(now, [*TREE, "node"], F.col("up").alias("next"), F.col("path").alias("before"))
        met = now.join(over, _same(now, over, TREE) & (now["up"] == over["node_"]), "left")
        path = F.when(F.col("before").isNull(), F.col("path")).otherwise(F.concat("before", "path"))
        now = written(met.select(*TREE, "node", "kind", F.col("next").alias("up"), path.alias("path")))
    raise ValueError("the parents of some nodes form a circle")


def subtree_table(nodes: DataFrame) -> DataFrame:
    """(example_id, side, node, depth, sexp): roots and the nodes with children, and a digest of the tree below each.

    nodes: what tree_paths takes, and optionally named. Two trees have equal digests if the kinds of their nodes and
    the order of siblings are equal; unnamed nodes are no part of them, but count as children. A tree is the set of its
    nodes' kinds and paths from its root, so its digest is a sum over them, which needs no order and no level to wait
    for: each node gives a row for every tree that it is in, and rows are added up before they are shuffled.
    """
    named = F.coalesce(F.col("named"), F.lit(True)) if "named" in nodes.columns else F.lit(True)
    rows = nodes.select(*TREE, "node", "parent", "ordinal", "kind", named.alias("named"))
    paths = cut(tree_paths(rows.where("named").drop("named")))
    parts = paths.select(*TREE, "kind", "path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n"))
    below = F.slice("path", F.col("n") + 1, F.size("path"))
    value = lambda seed: F.sum(F.xxhash64(F.lit(seed), "kind", below).cast("decimal(38,0)"))
    sums = parts.groupBy(*TREE, F.slice("path", 1, F.col("n")).alias("path")).agg(F.concat_ws(":", value(1), value(2), F.count("*")).alias("sexp"))
    sums = _marked(sums, [*TREE, "path"], F.col("sexp"))
    inner = _marked(rows.select(*TREE, F.col("parent").alias("node")).where("node is not null").distinct(), [*TREE, "node"])
    held = paths.join(inner, _same(paths, inner, [*TREE, "node"]), "left").where("node_ is not null or size(path) = 1").select(*[paths[c] for c in (*TREE, "node", "path")])
    return held.join(sums, _same(held, sums, [*TREE, "path"])).select(*[held[c] for c in (*TREE, "node")], F.size("path").alias("depth"), "sexp")


def merge_dataflow(edges: DataFrame) -> DataFrame:
    """Edges with sources, and those whose place is the source of one; edges at one place become one with all sources,
    in order, and the greatest relation. edges: example_id, side, pos, var, relation, src_vars, src_pos.

    Rows are dealt by example once: uses of a place travel with the edges, and no join is needed.
    """
    key = ["example_id", "side", "pos"]
    rows = dealt(edges.select(*key, "var", "relation", "src_vars", "src_pos"), "example_id")
    own = F.array(F.struct("pos", F.lit(True).alias("is_edge")))
    uses = F.transform("src_pos", lambda p: F.struct(p.alias("pos"), F.lit(False).alias("is_edge")))
    long = rows.withColumn("x", F.explode(F.concat(own, uses))).select("example_id", "side", "x.*", "var", "relation", "src_vars", "src_pos")
    sourced = F.col("is_edge") & (F.size("src_pos") > 0)
    sources = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(sourced, F.col(c))))))
    used = F.bool_or(~F.col("is_edge"))
    relation = F.when(used, F.max(F.when(F.col("is_edge"), F.col("relation")))).otherwise(F.max(F.when(sourced, F.col("relation"))))
    merged = long.groupBy(*key).agg(F.max(F.when(F.col("is_edge"), F.col("var"))).alias("var"), relation.alias("relation"), sources("src_vars").alias("src_vars"), sources("src_pos").alias("src_pos"))
    return merged.where(F.col("relation").isNotNull())


def normalize_dataflow(edges: DataFrame) -> DataFrame:
    """(example_id, side, edge): variables renamed by first appearance, by place, an edge's sources before its target.

    edges: merge_dataflow's table, on whose order and partitioning a text's edges come together; its names are numbered by
    an Arrow function, a batch of texts at a time.
    """
    small_batches(edges.sparkSession)
    text = ["example_id", "side"]

    @F.arrow_udf("array<string>")
    def named(relations: pa.Array, names: pa.Array) -> pa.Array:
        lists, many = gram_sums.lists(names)
        words, size = gram_sums.lists(lists)
        row = np.repeat(np.repeat(np.arange(len(many)), many), size)
        word = words.dictionary_encode()
        number, _ = pd.factorize(row * (len(word.dictionary) + 1) + word.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        # Names are numbered as they come, so those of a text begin at its first one's number.
        first = np.zeros(len(many), dtype=np.int64)
        first[row[::-1]] = number[::-1]
        rank = (number - first[row]).tolist()
        ends = np.cumsum(size)
        edges = [" ".join([r, *[f"var_{k}" for k in rank[e - n : e]]]) for r, n, e in zip(relations.flatten().to_pylist(), size.tolist(), ends.tolist(), strict=True)]
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(edges, pa.string()))

    own = F.struct("pos", "relation", F.concat(F.col("src_vars"), F.array("var")).alias("names"))
    held = edges.groupBy(*text).agg(F.array_sort(F.collect_list(own)).alias("e"))
    return held.select(*text, F.explode(named(F.col("e.relation"), F.col("e.names"))).alias("edge"))


def dataflow_counts(edges: DataFrame) -> DataFrame:
    """(example_id, d_match, d_all): reference edges, and those matched by an edge of the hypothesis, each used once."""
    side = lambda s: F.count(F.when(F.col("side") == s, 1))
    counts = normalize_dataflow(merge_dataflow(edges)).groupBy("example_id", "edge").agg(side("ref").alias("r"), side("hyp").alias("h"))
    return counts.groupBy("example_id").agg(F.sum(F.least("r", "h")).alias("d_match"), F.sum("r").alias("d_all"))


def share(match: Column, whole: Column) -> Column:
    """The matched share; null where nothing is to be matched."""
    return F.when(whole > 0, match / whole)


def combine(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """The weighted mean of the parts that are defined, times 100."""
    weights = weights or {p: 1 / len(PARTS) for p in PARTS}
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    value = add([F.coalesce(F.lit(weights[p]) * c, F.lit(0.0)) for p, c in parts.items()])
    return 100 * value / add([F.when(c.isNotNull(), weights[p]).otherwise(0.0) for p, c in parts.items()])


def code_bleu(stats: DataFrame, subtrees: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(example_id, ngram, weighted, syntax, dataflow, code_bleu) for each example as a corpus of one."""
    rden = {f"rden{n}": F.greatest(F.col(f"rden{n}"), F.lit(1.0)) for n in metrics.N}
    dens = [F.col("hlen") - (n - 1) for n in metrics.N]
    one = stats.withColumns(rden).join(syntax_counts(subtrees), "example_id", "left").join(dataflow_counts(edges), "example_id", "left")
    parts = {
        "ngram": metrics.bleu("method1", _list("num"), dens, F.col("hlen"), F.col("rlen")), "weighted": weighted_value("method1", "pair", F.lit(1)),
        "syntax": share(F.col("s_match"), F.col("s_all")), "dataflow": share(F.col("d_match"), F.col("d_all")),
    }
    return one.select("example_id", *[F.round(c, 6).alias(p) for p, c in parts.items()], F.round(combine(parts, weights), 6).alias("code_bleu"))


def corpus_code_bleu(stats: DataFrame, subtrees: DataFrame, edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """One row of the same parts for the whole corpus: sums first, the formulas last."""
    rows = corpus_sums(stats).crossJoin(syntax_counts(subtrees).agg(F.sum("s_match").alias("s_match"), F.sum("s_all").alias("s_all")))
    rows = rows.crossJoin(dataflow_counts(edges).agg(F.sum("d_match").alias("d_match"), F.sum("d_all").alias("d_all")))  # one row each
    parts = {
        "ngram": metrics.bleu("method1", _list("num"), _list("den"), F.col("hlen"), F.col("rlen")), "weighted": weighted_value("method1", "pair", F.col("examples")),
        "syntax": share(F.col("s_match"), F.col("s_all")), "dataflow": share(F.col("d_match"), F.col("d_all")),
    }
    return rows.select("examples", *[F.round(c, 6).alias(p) for p, c in parts.items()], F.round(combine(parts, weights), 6).alias("code_bleu"))
