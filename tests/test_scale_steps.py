"""Steps that had grown faster than their input, or held too much at a time."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import edits, pipelines, rerank, structure


def test_markers_are_found_by_a_hash_set_and_tokens_made_once(spark):
    """a text's tokens are split once for its last marker; a truncated text is not split to its end."""
    rows = spark.createDataFrame([(x,) for x in ("", " a\u00a0b ", "x <KEEP> y <s> z", "<INSERT>", "a b c d e f", " a b c d e f ")], "c string")
    got = rows.select(T.remove_edits(F.col("c")).alias("r"), T.truncate_tokens(F.col("c"), 2).alias("t"), T.separate_gen_edit(F.col("c"))[1].alias("e")).collect()
    assert [tuple(r) for r in got] == [("", "", ""), ("", "a b", ""), ("z", "x <KEEP>", "x <KEEP> y <s>"), ("", "<INSERT>", "<INSERT>"), ("", "a b", ""), ("", "a b", "")]
    plan = rows.select(T.remove_edits(F.col("c")).alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_contains" not in plan


def test_trees_are_never_broadcast(spark):
    """no side of a tree join goes through the driver."""
    nodes = spark.createDataFrame([(1, "ref", k, k // 2 if k else None, k, "x") for k in range(8)], "example_id long, side string, node int, parent int, ordinal int, kind string")
    assert "Broadcast" not in structure.subtree_table(nodes)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("use", ["edits", "rerank"])
def test_batches_are_small(spark, use):
    """a Python worker holds 512 rows of texts at a time, not Spark's 10,000."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        if use == "edits":
            edits.edit_opcodes("a", "b")
        else:
            rerank.score_candidates(spark.createDataFrame([], "example_id long, beam_rank int, full_src string, seq_to_score string"), lambda: lambda a, b: a.str.len())
        assert int(spark.conf.get(key)) <= 512
    finally:
        spark.conf.set(key, before)


def test_sides_of_long_plans_by_one_pass(spark):
    """the side of a plan is cut out, not put together token by token."""
    rnd = random.Random(8)
    plans = [[], ["a"], ["<KEEP>"], ["x", "<KEEP>", "a", "<KEEP_END>", "y", "<INSERT>", "b"]] + [rnd.choices(["a", "b.*", "<KEEPER>", *T.EDIT_TOKENS], k=rnd.randint(0, 40)) for _ in range(60)]
    df = spark.createDataFrame([(p,) for p in plans], "p array<string>")
    for side, mine in (("old", ("<KEEP>", "<DELETE>", "<REPLACE_OLD>")), ("new", ("<KEEP>", "<INSERT>", "<REPLACE_NEW>"))):
        want = []
        for p in plans:
            on, out = False, []
            for w in p:
                if w in T.EDIT_TOKENS:
                    on = w in mine
                elif on:
                    out.append(w)
            want.append(out)
        column = pipelines.plan_side(F.col("p"), side).alias("s")
        assert [r.s for r in df.select(column).collect()] == want
        assert "aggregate(" not in df.select(column)._jdf.queryExecution().optimizedPlan().toString()


def test_names_are_numbered_without_sorts_of_their_own(spark):
    """first appearance by place, sources before the target, for each text alone."""
    rows = [(1, "ref", 3, "b", "comesFrom", ["a"], [0]), (1, "ref", 0, "a", "comesFrom", [], []), (1, "ref", 5, "a", "computedFrom", ["b", "a"], [3, 0]), (2, "hyp", 1, "b", "comesFrom", ["b"], [0])]
    edges = spark.createDataFrame(rows, "example_id long, side string, pos int, var string, relation string, src_vars array<string>, src_pos array<int>")
    got = sorted(map(tuple, structure.normalize_dataflow(edges).collect()))
    assert got == [(1, "ref", "comesFrom var_0"), (1, "ref", "comesFrom var_0 var_1"), (1, "ref", "computedFrom var_1 var_0 var_0"), (2, "hyp", "comesFrom var_0 var_0")]
    assert "Window" not in structure.normalize_dataflow(edges)._jdf.queryExecution().executedPlan().toString()
