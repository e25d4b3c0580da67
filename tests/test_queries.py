"""Every registered query of the core against its SQL twin; formulas against known values."""

import pytest
from pyspark.sql import functions as F

import oracle
from palimpsest import catalog
from palimpsest.functions import text as T
from palimpsest.operators import corrupt, edits, metrics
from palimpsest.sources import views as V


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, sf, name):
    df = catalog.queries()[name](spark, sf)
    sql = catalog.oracle_sql().get(name)
    if sql:
        oracle.compare(df, sql, sf)
    else:
        assert df.count() > 0


def test_long_conversation_keeps_apart_from_its_neighbours(spark, tmp_path):
    sizes = {4: 8, 5: 150, 6: 60, 7: 8, 500_000_000_000: 1200}
    rows = [(c, t, ("user", "assistant")[t % 2], f"words of turn {t} in talk {c}") for c, n in sizes.items() for t in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = {r.example_id: r.source for r in V.turn_pairs(spark, str(tmp_path)).collect()}
    assert len(pairs) == sum(sizes.values()) // 2
    assert all(pairs[c * 100 + t] == text for c, t, role, text in rows if role == "user" and t < 100)
    for name in ("gleu", "rerank_best", "sari"):
        got = [r.example_id for r in catalog.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(pairs), name


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("<KEEP> a b <KEEP_END> <INSERT> c <INSERT_END>", "<INSERT> c <INSERT_END>"),
        ("x <KEEP> a b", "x"), ("x <KEEP>", "x"), ("a <KEEP_END> b", "a b"), ("", ""),
    ],
)
def test_remove_keep_span(spark, text, want):
    assert _one(spark, T.remove_keep_span(F.col("c")), text) == want


def test_edit_markers(spark):
    c = F.col("c")
    assert _one(spark, T.remove_edits(c), "<INSERT> a <INSERT_END> <s> b c") == "b c"
    assert _one(spark, T.remove_edits(c), "b c") == ""
    assert _one(spark, T.pad_edit_markers(c), "a<KEEP>b<KEEP_END>") == "a <KEEP> b <KEEP_END>"
    assert _one(spark, T.subtokenize_comment(c), "/** @return theFooBar_x <b>it</b> {@code z} */") == "the foo bar _ x it z"


def test_sari_known_values(spark):
    src = "About 95 species are currently accepted ."
    refs = ["About 95 species are currently known .", "About 95 species are now accepted .", "95 species are now accepted ."]
    hyps = ["About 95 you now get in .", "About 95 species are now agreed .", "About 95 species are currently agreed ."]
    rows = spark.createDataFrame([(k, src, h, refs) for k, h in enumerate(hyps)], "example_id long, src string, pred string, refs array<string>")
    got = {r.example_id: r.sari for r in metrics.sari(rows).collect()}
    for k, v in enumerate((26.82782411698074, 58.89995423074248, 50.71608864657479)):
        assert got[k] == pytest.approx(v, abs=1e-5)


def test_identity_scores(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "a b c d e f", "a b c d e f"), (2, "", "x", "")], "example_id long, src string, ref string, pred string")
    stats = metrics.overlap_stats(rows)
    assert {r.example_id: r.bleu_method2_higher_orders for r in metrics.sentence_bleu(stats).collect()} == {1: 100.0, 2: 0.0}
    assert {r.example_id: r.gleu for r in metrics.sentence_gleu(stats).collect()}[1] == 1.0


def test_code_edit_plan(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x c d e".split())], "o array<string>, n array<string>")
    df = df.withColumn("ops", edits.edit_opcodes("o", "n"))
    o, n = F.col("o"), F.col("n")
    row = df.select(
        F.array_join(edits.code_edit_plan(F.col("ops"), o, n), " ").alias("plan"), F.array_join(edits.edit_commands(F.col("ops"), o, n), " ").alias("cmd"),
        edits.replay_opcodes(F.col("ops"), o, n).alias("back"),
    ).first()
    assert row.plan == "<KEEP> a <KEEP_END> <REPLACE_OLD> b <REPLACE_NEW> x <REPLACE_END> <KEEP> c d <KEEP_END> <INSERT> e <INSERT_END>"
    assert row.cmd == "<KEEP> <REPLACE_OLD> <REPLACE_NEW> x <KEEP> <KEEP> <INSERT> e"
    assert row.back == "a x c d e".split()


@pytest.mark.parametrize(("modality", "sizes", "noise"), [("nl", (1, 2, 3, 10), {2: 1, 3: 2, 10: 4}), ("code", (10, 11, 12, 13, 14), {10: 9, 14: 12})])
def test_corruption_lengths(spark, modality, sizes, noise):
    lines = spark.createDataFrame([(n, " ".join(f"t{i}" for i in range(n))) for n in sizes], "id long, text string")
    got = {r.id: r.n_noise for r in corrupt.corrupt(lines, modality).collect()}
    assert got == noise


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_rouge_l_matches_plain_dynamic_programming(spark):
    import random

    rnd = random.Random(1)
    text = lambda: " ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 80)))
    hyps, refs = [(k, text()) for k in range(60)], [(k, j, text()) for k in range(60) for j in range(2)]
    got = metrics.rouge_l(spark.createDataFrame(hyps, "example_id long, pred string"), spark.createDataFrame(refs, "example_id long, ref_idx int, ref string"))
    got = {r.example_id: r.rouge_l for r in got.collect()}
    for k, h in hyps:
        own = [r.split(" ") for i, _, r in refs if i == k]
        p, q = max(_lcs(r, h.split(" ")) / len(h.split(" ")) for r in own), max(_lcs(r, h.split(" ")) / len(r) for r in own)
        assert got[k] == pytest.approx((1 + 1.44) * p * q / (q + 1.44 * p) if p and q else 0, abs=1e-6)


def test_line_files_round_trip(spark, tmp_path):
    from palimpsest.sources import lines

    rows = spark.createDataFrame([(k, f"a {k}", f"b\n{k}") for k in range(25)], "line_no long, x string, y string").repartition(5)
    paths = {c: str(tmp_path / c) for c in "xy"}
    lines.write_parallel_lines(rows, paths)
    back = lines.read_parallel_lines(spark, paths)
    assert sorted(tuple(r) for r in back.collect()) == [(k, f"a {k}", f"b {k}") for k in range(25)]
    beams = lines.read_beam_lines(spark, paths["x"], 5)
    assert {(r.example_id, r.beam_rank): r.pred for r in beams.collect()}[2, 3] == "a 13"
    lines.write_beam_lines(beams, str(tmp_path / "beams"))
    assert lines.read_beam_lines(spark, str(tmp_path / "beams"), 5).count() == 25
    with pytest.raises(ValueError):
        lines.read_beam_lines(spark, paths["x"], 4)
    assert lines.merge_gap_check(spark.createDataFrame([(0,), (1,), (3,)], "id long")).first().gapless is False


def test_streaming_projection(spark, sf, tmp_path):
    import os

    os.symlink(f"{sf}/documents.parquet", tmp_path / "documents.parquet")
    batch = spark.read.parquet(f"{sf}/documents.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path))
    column = T.subtokenize_comment(F.col("text")).alias("text")
    query = stream.select("doc_id", column).writeStream.format("memory").queryName("subtokens").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("subtokens").collect())) == sorted(map(tuple, batch.select("doc_id", column).collect()))
