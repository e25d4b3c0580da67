"""Gram sums inside the task: against plain counting, and without moving rows."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.operators import gram_sums, metrics


def _moves(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_grams_match_plain_counting():
    rnd = random.Random(4)
    rows = [[None if rnd.random() < 0.1 else rnd.choices(["a", "b", "é", "x\u0002"], k=rnd.randint(0, 9)) for _ in range(3)] for _ in range(40)]
    want = Counter()
    for r, sides in enumerate(rows):
        for s, t in enumerate(sides):
            for n in range(1, 5):
                for i in range(len(t or []) - n + 1):
                    if not any("\u0002" in w for w in t[i : i + n]):
                        want[r, n, s] += 1
                        want[r, n, s, *t[i : i + n]] += 1
    texts = gram_sums._side_texts([pa.array([r[s] for r in rows], pa.list_(pa.string())) for s in range(3)])
    digests = {}
    for g in gram_sums.grams(texts, 4, "\u0002", digests=True):
        counts = g.counts(3)
        assert [[want[r, g.n, s] for s in range(3)] for r in range(40)] == [[int(gram_sums.by_row(g, 40, counts[:, s])[r]) for s in range(3)] for r in range(40)]
        gram, side, count = g.pairs(3)
        dense = np.zeros_like(counts)
        dense[gram, side] = count
        assert (dense == counts).all()
        assert Counter(zip(g.row.tolist(), map(tuple, counts.tolist()))) == Counter(
            (r, tuple(want[r, g.n, s, *t] for s in range(3))) for r, t in {(k[0], k[3:]) for k in want if len(k) > 3 and k[1] == g.n}
        )
        for d in map(tuple, np.unique(g.digest, axis=0).tolist()):
            digests[d] = g.n
    assert len(digests) == len({k[3:] for k in want if len(k) > 3})
    assert list(gram_sums._slices(np.array([gram_sums.SLICE_TOKENS + 5, 1, gram_sums.SLICE_TOKENS - 1, 1, 0]))) == [(0, 1), (1, 3), (3, 5)]


def test_summary_moves_no_gram(spark):
    """A row's sums are taken where the row is; only the summary's one row moves."""
    rows = spark.createDataFrame([(1, "a b", "a c", "a c d"), (2, None, "", "x")], "example_id long, src string, ref string, pred string")
    assert _moves(metrics.overlap_stats(rows)) == 0
    assert _moves(metrics.sari(rows.withColumn("refs", F.array("ref")))) == 0
    assert _moves(metrics.evaluation_summary(rows, False)) == 1


def test_gram_counts_move_no_row(spark):
    """a document's counts are taken where it is."""
    from palimpsest.operators import ngrams

    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, []), (3, None)], "doc_id long, t array<string>")
    got = ngrams.gram_counts(docs, "doc_id", F.col("t"))
    assert _moves(got) == 0
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 4, 2), (1, 2, 2, 3, 2), (1, 3, 2, 2, 1), (1, 4, 1, 1, 1)]


def _refs(spark):
    rows = spark.createDataFrame([(k, f"a b c {k}", f"a b {k} c") for k in range(6)], "example_id long, src string, pred string")
    refs = spark.createDataFrame([(k, j, f"a b c {k} {j}") for k in range(6) for j in range(3)], "example_id long, ref_idx int, ref string")
    return rows, refs


def test_several_references_share_one_shuffle(spark):
    """an example's texts come together once, and no gram moves."""
    rows, refs = _refs(spark)
    for df in (metrics.multi_ref_stats(rows, refs, strict=True), metrics.original_gleu_stats(rows, refs), metrics.multi_ref_gleu_stats(rows, refs)):
        assert _moves(df) == 1
        assert "gram" not in df._jdf.queryExecution().executedPlan().toString().replace("gram_sums", "")


def test_lengths_of_several_references(spark):
    """Of references equally near the shorter counts for BLEU, the first for the superseded GLEU; ids on one side only stay."""
    rows = spark.createDataFrame([(1, "s", "a b c"), (2, "s", None), (4, "s", "x")], "example_id long, src string, pred string")
    refs = spark.createDataFrame([(1, 5, "a b"), (1, 0, "a b c d"), (2, 0, "q"), (3, 0, "q r")], "example_id long, ref_idx int, ref string")
    got = {r.example_id: (r.hlen, r.rlens.closest, r.rlens.shortest, r.rlens.average) for r in metrics.all_lengths_stats(rows, refs).collect()}
    assert got == {1: (3, 2, 2, 3), 2: (0, 1, 1, 1), 3: (0, 2, 2, 2)}
    assert {r.example_id: (r.hlen, r.rlen) for r in metrics.original_gleu_stats(rows, refs).collect()} == {1: (3, 4), 2: (0, 1), 3: (0, 2), 4: (1, None)}


def test_only_shared_grams_are_looked_up(spark, monkeypatch):
    """grams of one example are not among the frequencies, which alone are joined and sent back."""
    rows, refs = _refs(spark)
    seen, plain = {}, metrics.attach_frequency
    monkeypatch.setattr(metrics, "attach_frequency", lambda t, df: plain(t, seen.setdefault("df", df)))
    got = metrics.cider(rows, refs).collect()
    assert len(got) == 6
    # a, b, c, a b, b c, a b c, and the three reference numbers, which are ids as well.
    assert [r.df for r in seen["df"].collect()] == [6] * 9


def test_caption_scores_are_made_once(spark):
    """The four BLEU columns come out of one set of statistics."""
    rows, refs = _refs(spark)
    plan = metrics.caption_suite(rows, refs)._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.splitlines() if not line.startswith("(")) <= 3
