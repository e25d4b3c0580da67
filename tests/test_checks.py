"""Checks that ride on the result: an error of the query itself that names the row."""

import pytest

from palimpsest.operators import metrics
from palimpsest.sources import lines


def test_files_of_different_lengths(spark, tmp_path):
    for name, n in (("a", 5), ("b", 5), ("c", 4), ("d", 10), ("e", 8)):
        spark.range(n).selectExpr("cast(id as string) as value").coalesce(1).write.text(str(tmp_path / name))
    at = lambda *names: {x: str(tmp_path / x) for x in names}
    assert lines.read_parallel_lines(spark, at("a", "b")).count() == 5
    for names in (("a", "c"), ("c", "a", "b")):
        with pytest.raises(Exception, match="different lengths, such as line_no 4"):
            lines.read_parallel_lines(spark, at(*names)).collect()
    assert lines.align_eval(spark, at("a", "b"), str(tmp_path / "d"), 2).count() == 10
    for preds in "de":
        with pytest.raises(ValueError, match="candidates are not 2 for each of"):
            lines.align_eval(spark, at("a" if preds == "e" else "c"), str(tmp_path / preds), 2).collect()


def test_rescored_hypotheses_have_the_same_examples(spark):
    refs = spark.createDataFrame([(1, 0, "a b c"), (2, 0, "a")], "example_id long, ref_idx int, ref string")
    hyps = lambda *ids: spark.createDataFrame([(i, "a b") for i in ids], "example_id long, pred string")
    assert metrics.rescore(refs, hyps(1, 2)).count() == 2
    for ids, alone in (((1,), 2), ((1, 2, 3), 3)):
        with pytest.raises(Exception, match=f"one side only, such as {alone}"):
            metrics.rescore(refs, hyps(*ids)).collect()
    assert metrics.multi_ref_stats(hyps(1, 2, 3), refs).count() == 2
