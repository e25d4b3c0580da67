"""The twins of written plans tell right plans from others that lead to the same text."""

import pytest
from pyspark.sql import functions as F

import oracle
from palimpsest.functions import text as T
from palimpsest.operators import edits
from palimpsest.plans import plan_texts
from palimpsest.plans import queries as Q


def test_plans_that_replace_everything_do_not_match(spark, sf):
    _, sql = plan_texts.QUERIES["minimal_plan_text"]
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    whole = F.array_join(edits.full_replace_plan(old, new), " ")
    with pytest.raises(AssertionError):
        oracle.compare(Q.pairs(spark, sf).select("example_id", whole.alias("other"), whole.alias("comment")), sql, sf)
    query, sql = plan_texts.QUERIES["opcode_table"]
    with pytest.raises(AssertionError):
        oracle.compare(query(spark, sf).withColumn("o_end", F.col("o_end") + (F.col("tag") == "equal").cast("int")), sql, sf)


def test_plans_of_long_texts_with_popular_tokens_match_sql(spark, tmp_path):
    """Texts of 200 tokens and more, where tokens that are frequent in the new text start no run."""
    import os
    import random

    rnd = random.Random(2)
    rows = []
    for c in range(6):
        old = rnd.choices(["a", "b", "the", "of", *(f"w{k}" for k in range(60))], weights=[9, 9, 20, 20, *[1] * 60], k=rnd.randint(200, 330))
        new = list(old)
        for _ in range(12):
            at = rnd.randint(0, len(new))
            new[at : at + rnd.randint(0, 4)] = rnd.choices(["the", "x", "b"], k=rnd.randint(0, 4))
        rows += [(c, 0, "user", " ".join(old)), (c, 1, "assistant", " ".join(new))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "made"))
    source = "/root/testdata/sf0.001"
    for name in os.listdir(source):
        os.symlink(f"{source}/{name}" if name != "conversations.parquet" else next(str(p) for p in (tmp_path / "made").glob("part-*.parquet")), tmp_path / name)
    for name in ("opcode_table", "code_plan_text", "minimal_plan_text"):
        query, sql = plan_texts.QUERIES[name]
        df = query(spark, str(tmp_path))
        assert df.count() >= 6
        oracle.compare(df, sql, str(tmp_path))
