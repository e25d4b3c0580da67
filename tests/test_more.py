"""Line files of any size, plan properties, general corruption and small checks."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import corrupt, metrics, plans, rerank
from palimpsest.operators.ngrams import ngram_table, pad_sequence
from palimpsest.sources import lines


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_lines_of_files_of_opposite_sizes_stay_paired(spark, tmp_path, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # Small parts, so that one file is read in several.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        n = 4000
        rows = spark.range(0, n, 1, 7).select(
            F.col("id").alias("line_no"), F.concat(F.lit("a"), F.col("id"), F.repeat(F.lit("x"), (F.col("id") / 100).cast("int"))).alias("x"),
            F.concat(F.lit("b"), F.col("id"), F.repeat(F.lit("y"), ((n - F.col("id")) / 100).cast("int"))).alias("y"),
        )
        paths = {c: str(tmp_path / c) for c in "xy"}
        lines.write_parallel_lines(rows.orderBy(F.rand(1)), paths)
        got = lines.read_parallel_lines(spark, paths).collect()
        assert sorted(r.line_no for r in got) == list(range(n))
        assert all(r.x.rstrip("x") == f"a{r.line_no}" and r.y.rstrip("y") == f"b{r.line_no}" for r in got)
        spark.conf.set("spark.sql.files.maxPartitionBytes", before["spark.sql.files.maxPartitionBytes"])
        aligned = lines.align_eval(spark, {"x": paths["x"]}, paths["y"])
        assert aligned.where("beam_rank = 0").count() == n
        with pytest.raises(ValueError):
            lines.align_eval(spark, {"x": paths["x"]}, paths["y"], 2)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_parts_are_read_in_the_order_of_their_numbers(spark, tmp_path):
    for name, text in (("part-00002-a.txt", "c\n"), ("part-00000-a.txt", "a\nlong line that makes this the largest file\n"), ("part-100000-a.txt", "e\n"), ("part-00010-a.txt", "d\n")):
        (tmp_path / name).write_text(text)
    got = [r.x for r in lines.read_lines(spark, str(tmp_path), "x").orderBy("line_no").collect()]
    assert got == ["a", "long line that makes this the largest file", "c", "d", "e"]


def test_blanks_are_those_of_unicode(spark):
    blanks = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0       　"
    text = "a" + "b".join(blanks) + "c​d"
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(T.tokens(F.col("c")).alias("v")).first().v == text.split()


def _edited(rnd, words):
    new = list(words)
    for _ in range(rnd.randint(0, 5)):
        at = rnd.randint(0, len(new))
        new[at : at + rnd.randint(0, 3)] = [rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(0, 3))]
    return new


def test_plans_of_random_edits(spark):
    """Repeated words too. A minimal plan names phrases that stand once, so its replay gives the new text; a code plan's
    sides are the two texts."""
    rnd = random.Random(9)
    rows = []
    for k in range(600):
        old = [rnd.choice("abcdefgh") + str(rnd.randint(0, 3)) for _ in range(rnd.randint(1, 30))]
        rows.append((k, old, _edited(rnd, old)))
    df = spark.createDataFrame(rows, "id long, o array<string>, n array<string>")
    for mode in ("other", "comment"):
        t = df.withColumn("plan", plans.edit_plan(mode, F.col("o"), F.col("n"))).withColumn("text", plans.apply_edit_plan("minimal", F.col("o"), F.col("plan")))
        for r in t.collect():
            for kind, runs, _ in plans.steps(list(r.plan), plans.MINIMAL_STEPS):
                assert len(plans.Places(list(r.o)).of(runs[0])) == 1 or runs[0] == r.o, kind
            assert r.text == " ".join(r.n)
    from palimpsest.operators.pipelines import plan_side

    t = df.withColumn("plan", plans.edit_plan("code", F.col("o"), F.col("n"))).withColumn("text", plans.apply_edit_plan("code", F.col("o"), F.col("plan")))
    got = t.select("o", "n", "text", plan_side(F.col("plan"), "old").alias("a"), plan_side(F.col("plan"), "new").alias("b")).collect()
    assert all(r.a == r.o and r.b == r.n for r in got)
    # With words that repeat, a replay that looks for the next equal word can take another one, but never of another kind.
    assert sum(r.text == " ".join(r.n) for r in got) >= 0.9 * len(got)


@pytest.mark.parametrize(("old", "plan", "want"), [
    ("a b c", "<INSERT_OLD> b <INSERT_NEW> b x <INSERT_END>", "a b x c"), ("a b c", "<DELETE> b", "a c"), ("a b c", "<REPLACE_OLD> b <REPLACE_NEW> x", "a x c"),
    ("a b c d", "<REPLACE_OLD> q b c <REPLACE_NEW> x <REPLACE_END>", "a x d"), ("q a b c d", "<REPLACE_OLD> q b c <REPLACE_NEW> x <REPLACE_END>", "a x d"),
    ("a b a c", "<DELETE> c <DELETE_END> <DELETE> a <DELETE_END>", "a b a"), ("a b a b a", "<REPLACE_OLD> b <REPLACE_NEW> x y <REPLACE_END>", "a x y a x y a"),
])
def test_minimal_replay_cases(old, plan, want):
    assert plans.replay_minimal(old.split(), plan.split()) == want


def test_corruption_with_many_spans(spark):
    rows = spark.createDataFrame([(k, " ".join(f"t{i}" for i in range(n))) for k, n in enumerate((3, 9, 20, 60))], "id long, text string")
    got = {r.id: r for r in corrupt.corrupt(rows, "nl", spans=(4.0, 2.0)).collect()}
    for k, n in ((2, 20), (3, 60)):
        r = got[k]
        assert sum(r.mask) == r.n_noise == 8 and len(r.mask) == n and r.mask[0] == 0 and r.mask[-1] == 1
        assert sum(b > a for a, b in zip(r.mask, r.mask[1:])) == 4
        assert len(r.labels) == len(r.noisy.split()) and set(r.labels) <= {"<KEEP>", "<DELETE>", "<REPLACE>", "<INSERT>"}
        assert sum(x in ("<DELETE>", "<REPLACE>", "<INSERT>") for x in r.labels) == 4
    assert 0 in got and sum(got[0].mask) == 2 and 1 not in got
    # Every way to cut six into three is met, about as often as any other.
    many = spark.range(3000).select("id", corrupt.composition(F.lit(6), F.lit(3), 1, F.col("id"), "x").alias("c")).groupBy("c").count().collect()
    assert len(many) == 10 and all(sum(r.c) == 6 and min(r.c) > 0 for r in many) and min(r["count"] for r in many) > 200


def test_keys_beams_and_padding(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "example_id long") for ks in ((1, 2), (1, 3)))
    metrics.assert_same_keys(a, a)
    with pytest.raises(ValueError, match="one side only"):
        metrics.assert_same_keys(a, b)
    beams = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "example_id long, beam_rank int")
    assert rerank.keep_beams(beams, 2, exact=False).count() == 3
    with pytest.raises(ValueError, match="not 2 candidates"):
        rerank.keep_beams(beams, 2)
    shards = spark.createDataFrame([(0, "a", 0), (2, "b", 0)], "id long, data string, rank int")
    with pytest.raises(ValueError, match="gaps"):
        rerank.merge_prediction_shards(shards, gapless=True)
    df = spark.createDataFrame([([1, 2, 3, 4, 5],)], "t array<int>").select(F.transform("t", lambda x: x.cast("string")).alias("t"))
    assert df.select(pad_sequence(F.col("t"), 2, "<s>", "</s>").alias("v")).first().v == ["<s>", "1", "2", "3", "4", "5", "</s>"]
    assert df.select(pad_sequence(F.col("t"), 2).alias("v")).first().v == ["1", "2", "3", "4", "5"]


def test_gram_table_matches_plain_counts(spark):
    rows = [(1, "a b a b a", "a"), (2, "", "x y"), (3, "", "")]
    df = spark.createDataFrame(rows, "k long, p string, q string")
    for whole in (False, True):
        got = {(r.k, r.n, r.gram): (r.c_p, r.c_q) for r in ngram_table(df, ["k"], {"p": T.tokens(F.col("p")), "q": T.tokens(F.col("q"))}, whole=whole).collect()}
        want = {}
        for k, *sides in rows:
            for s, text in enumerate(sides):
                w = text.split()
                for n in range(1, 5):
                    for i in range(len(w) - n + 1):
                        want.setdefault((k, n, "\u0001".join(w[i : i + n])), [0, 0])[s] += 1
            if whole:
                want[k, 0, ""] = [1, 1]
        assert got == {k: tuple(v) for k, v in want.items()}


def test_frequencies_join_alike_by_any_way(spark, monkeypatch):
    hyps = spark.createDataFrame([(k, f"a b c w{k} d") for k in range(30)], "example_id long, pred string")
    refs = spark.createDataFrame([(k, j, f"a b w{k} d e" if j else "a c") for k in range(30) for j in range(2)], "example_id long, ref_idx int, ref string")
    want = sorted(map(tuple, metrics.cider(hyps, refs).collect()))
    monkeypatch.setattr(metrics, "SMALL_GRAMS", 0)
    monkeypatch.setattr(metrics, "HOT_GRAM", 5)
    assert sorted(map(tuple, metrics.cider(hyps, refs).collect())) == want
