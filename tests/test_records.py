"""Nested records, rerank preparation, caption metrics and small column functions."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import corrupt, metrics, rerank
from palimpsest.plans import queries
from palimpsest.sources import lines, records


def test_beam_records_round_trip(spark, tmp_path):
    beams = spark.createDataFrame(
        [(i, f"s{i}", "r", "fs", "fr", None, None, b, f"p{b}", f"q{b}", b / 4) for i in range(3) for b in range(4)],
        "example_id long, src string, ref string, full_src string, full_ref string, pred_edits string, rerank_pred string, beam_rank int, pred string, seq_to_score string, base_score double",
    )
    records.write_beam_json(beams, str(tmp_path / "b"))
    back = records.read_beam_json(spark, str(tmp_path / "b"))
    assert sorted(map(str, back.select(beams.columns).collect())) == sorted(map(str, beams.collect()))


def test_score_and_text_files(spark, tmp_path):
    long = spark.createDataFrame([(k, m, k * 1.0) for k in range(5) for m in ("a", "b")], "example_id long, metric string, value double")
    records.write_scores_json(long, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).groupBy("metric").count().collect()[0]["count"] == 5
    rows = spark.createDataFrame([(0, "comment-update", "fooBar"), (1, "code", "fooBar")], "line_no long, dataset string, src string")
    records.write_eval_text(rows, {"src": str(tmp_path / "t")})
    assert [r.src for r in lines.read_lines(spark, str(tmp_path / "t"), "src").orderBy("line_no").collect()] == ["foo bar", "fooBar"]
    data = spark.createDataFrame([("d", s, k) for s in ("train", "test") for k in (7, 3)], "dataset string, split string, example_id long")
    records.write_edit_dataset(data, str(tmp_path / "e"))
    assert {(r.split, r.example_id, r.line_no) for r in spark.read.parquet(str(tmp_path / "e")).collect()} == {(s, k, n) for s in ("train", "test") for k, n in ((3, 0), (7, 1))}


def test_rerank_preparation(spark):
    beams = spark.createDataFrame([(1, 0, "a x c", 0.1), (1, 1, "a b", 0.3)], "example_id long, beam_rank int, pred string, base_score double")
    examples = spark.createDataFrame([(1, "a b c </s>", "a x c", "ctx")], "example_id long, src string, ref string, ctx string")
    rows = rerank.prepare_rerank(beams, examples, True)
    got = {r.beam_rank: (r.full_src, r.seq_to_score) for r in rows.collect()}
    assert got[0] == ("a b c </s> </s> ctx", "<REPLACE_OLD> b <REPLACE_NEW> x <REPLACE_END> <s> a x c")
    assert got[1][1] == "<DELETE> c <DELETE_END> <s> a b"
    scores = rerank.score_candidates(rows, lambda: lambda a, b: b.str.len() * 1.0)
    assert tuple(rerank.unmatched_scores(rows, scores).first()) == (0, 0, 0)
    assert rerank.rerank(rows, scores).first().rerank_pred == "a x c"
    other = scores.where("beam_rank = 0").withColumn("hyp", F.lit("z"))
    assert tuple(rerank.unmatched_scores(rows, other).first()) == (1, 0, 1)
    comment = rerank.prepare_rerank(beams.limit(1).withColumn("pred", F.lit("@return  x")), examples, False, comment=True)
    assert comment.first().seq_to_score == "x"


def test_captions_leave_punctuation_out(spark):
    hyps = spark.createDataFrame([(1, "A man , runs ."), (2, "x y z w")], "example_id long, pred string")
    refs = spark.createDataFrame([(1, 0, "a man runs"), (2, 0, "q r s t")], "example_id long, ref_idx int, ref string")
    got = {r.example_id: r for r in metrics.caption_suite(hyps, refs).collect()}
    assert got[1].rouge_l == 1.0 and got[1].bleu_3 == pytest.approx(1.0, abs=1e-5) and got[2].rouge_l == 0.0
    assert not math.isnan(got[2].cider)


def test_replayed_predictions_restore_the_candidates(spark, sf):
    for r in queries.q_reconstruct_predictions(spark, sf).collect():
        assert r.restored >= 0.9 * r.examples


def test_small_columns(spark):
    one = lambda column, value, kind="string": spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("v")).first().v
    c = F.col("c")
    m = one(T.marker_class(c), "<REPLACE_NEW_KEEP_BEFORE>")
    assert m.replace and m.keep and m.new and not m.start and not m.end and not m.delete
    assert not any(one(T.marker_class(c), "KEEPER")) and not any(one(T.marker_class(c), None))
    assert one(T.repair_utf8(c), bytearray(b"a\xffb"), "binary") == "a\ufffdb"
    assert one(T.replace_unknown(c), "a <unk>") == "a \u8d54"
    assert one(T.dataset_text(F.lit("x-comment-update"), c), "fooBar") == "foo bar"
    spans = lambda v: [tuple(s) for s in one(corrupt.noise_spans(c), v, "array<int>")]
    assert spans([0, 1, 1, 0, 1]) == [(1, 3), (4, 5)] and spans([1]) == [(0, 1)] and spans([]) == [] and spans([0, 0]) == []
