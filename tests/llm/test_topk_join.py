"""The grid of blocks is joined by a shuffle, whatever Spark takes its sides for."""

from pyspark.sql import functions as F

from palimpsest.llm import topk


def test_blocks_never_go_through_the_driver(spark):
    """the sides repeat their blocks after the last size that Spark knows, so a small estimate says nothing."""
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    found = topk.top_k(df, query_block=2, candidate_block=20)
    assert found.count() == 8 * 5 and len(found.collect()) == 8 * 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan and "SortMergeJoin" in plan
