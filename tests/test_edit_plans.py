"""Minimal plans, their replay, smoothing, the code metric's parts and code columns against known or plain results."""

import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import code
from palimpsest.functions import text as T
from palimpsest.operators import metrics, plans, structure


def _minimal(old, new, mode="other"):
    ops = [dict(zip(("tag", "o_start", "o_end", "n_start", "n_end"), x, strict=True)) for x in difflib.SequenceMatcher(None, old.split(), new.split()).get_opcodes()]
    return " ".join(plans.minimal_plan(ops, old.split(), new.split(), mode))


@pytest.mark.parametrize(
    ("old", "new", "other", "comment"),
    [
        ("a b c", "a b c", "", ""),
        ("a b c", "a c", "<DELETE> b <DELETE_END>", "<DELETE> b <DELETE_END>"),
        ("a b c", "a x c", "<REPLACE_OLD> b <REPLACE_NEW> x <REPLACE_END>", "<REPLACE_OLD> b <REPLACE_NEW> x <REPLACE_END>"),
        ("a b c", "a b x c", "<REPLACE_OLD> b <REPLACE_NEW> b x <REPLACE_END>", "<INSERT_OLD_KEEP_BEFORE> b <INSERT_NEW_KEEP_BEFORE> b x <INSERT_END>"),
        ("a b", "x a b", "<REPLACE_OLD> a <REPLACE_NEW> x a <REPLACE_END>", "<INSERT_OLD_KEEP_AFTER> a <INSERT_NEW_KEEP_AFTER> x a <INSERT_END>"),
        ("p b q b r", "p b q x r", "<REPLACE_OLD> q b <REPLACE_NEW> q x <REPLACE_END>", "<REPLACE_OLD_KEEP_BEFORE> q b <REPLACE_NEW_KEEP_BEFORE> q x <REPLACE_END>"),
        ("b q b r", "q b r", "<REPLACE_OLD> b q <REPLACE_NEW> q <REPLACE_END>", "<REPLACE_OLD_DELETE_KEEP_AFTER> b q <REPLACE_NEW_DELETE_KEEP_AFTER> q <REPLACE_END>"),
        ("b b", "x", "<REPLACE_OLD> b b <REPLACE_NEW> x <REPLACE_END>", "<REPLACE_OLD> b b <REPLACE_NEW> x <REPLACE_END>"),
        ("b b b", "b x b b", "<REPLACE_OLD> b b b <REPLACE_NEW> b x b b <REPLACE_END>", None),
        ("", "x y", "<REPLACE_OLD> <REPLACE_NEW> x y <REPLACE_END>", None),
    ],
)
def test_minimal_plan(old, new, other, comment):
    assert _minimal(old, new) == other
    if comment is not None:
        assert _minimal(old, new, "comment") == comment


def test_plans_replay_to_the_new_text():
    rnd = random.Random(3)
    for _ in range(400):
        old = [f"w{k}" for k in range(rnd.randint(1, 25))]
        new = list(old)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(new))
            new[at : at + rnd.randint(0, 2)] = [f"n{rnd.randint(0, 99)}" for _ in range(rnd.randint(0, 2))]
        for mode in ("other", "comment"):
            plan = _minimal(" ".join(old), " ".join(new), mode).split()
            assert plans.replay_minimal(old, plan) == " ".join(new), (old, new, plan)


def test_replay_of_code_plans():
    old = "a b c d".split()
    go = lambda p: plans.replay_code(old, p.split())
    assert go("<KEEP> a <KEEP_END> <INSERT> x <INSERT_END> <KEEP> b c d <KEEP_END>") == "a x b c d"
    assert go("<DELETE> b <DELETE_END>") == "a c d"
    assert go("<REPLACE_OLD> b <REPLACE_NEW> x y <REPLACE_END> <KEEP> c <KEEP_END>") == "a x y c d"
    assert go("<INSERT> x <INSERT_END>") == "a b c d x"
    assert go("<INSERT> x <KEEP> y") == ""
    assert go("") == "a b c d"
    assert go("<DELETE> zz <DELETE_END>") == "a b c d"


def test_replay_of_ambiguous_and_missing_phrases():
    assert plans.replay_minimal("a b a b".split(), "<DELETE> b <DELETE_END>".split()) == "a a"
    assert plans.replay_minimal("a b a b".split(), "<REPLACE_OLD> b <REPLACE_NEW> x <REPLACE_END>".split()) == "a x a x"
    assert plans.replay_minimal("a b".split(), "<REPLACE_OLD> q <REPLACE_NEW> x <REPLACE_END>".split()) == "a b"
    assert plans.replay_minimal("a b c".split(), "<KEEP> <DELETE> b".split()) == "a c"


def test_null_sides_and_modes(spark):
    df = spark.createDataFrame([(None, ["a"]), (["a"], None), ([], [])], "o array<string>, n array<string>")
    df = df.withColumn("p", plans.edit_plan("other", F.col("o"), F.col("n"))).withColumn("t", plans.apply_edit_plan("minimal", F.col("o"), F.col("p")))
    assert [(r.p, r.t) for r in df.collect()] == [(None, None), (None, None), ([], "")]
    assert df.select(plans.apply_edit_plan("unknown", F.col("o"), F.col("p")).alias("t")).first().t is None


def test_smoothing_known_values(spark):
    hyp = "It is a guide to action which ensures that the military always obeys the commands of the party"
    ref = "It is a guide to action that ensures that the military will forever heed Party commands"
    rows = spark.createDataFrame([(1, "", ref, hyp)], "example_id long, src string, ref string, pred string")
    methods = ("method0", "method1", "method2", "method3", "method4", "method5", "method6", "method7")
    got = metrics.sentence_bleu(metrics.overlap_stats(rows, 5), methods).first()
    want = (0.4118, 0.4118, 0.4489, 0.4118, 0.4118, 0.4905, 0.4135, 0.4905)
    for m, w in zip(methods, want, strict=True):
        assert math.floor(got[f"bleu_{m}"] * 100) / 10000 == w, m


def test_zero_counts_are_smoothed_by_order(spark):
    rows = spark.createDataFrame([(1, "", "a b c d e", "a x c y e z")], "example_id long, src string, ref string, pred string")
    got = metrics.sentence_bleu(metrics.overlap_stats(rows, 5), ("method3", "method4", "method6")).first()
    p3 = [3 / 6, 1 / (2 * 5), 1 / (4 * 4), 1 / (8 * 3)]
    p4 = [3 / 6, (1 + 5 / math.log(6)) / 5, (2 + 5 / math.log(6)) / 4, (3 + 5 / math.log(6)) / 3]
    for m, p in (("method3", p3), ("method4", p4)):
        assert got[f"bleu_{m}"] == pytest.approx(100 * math.exp(sum(map(math.log, p)) / 4), abs=1e-4)
    assert got.bleu_method6 is None


def test_spread_and_summary_with_supplied_parts(spark):
    s = metrics.score_spread(spark.createDataFrame([(1.0,), (3.0,)], "v double"), "v").first()
    assert (s["mean"], s.sd, s.low) == (2.0, 1.0, pytest.approx(0.040036))
    rows = spark.createDataFrame([(1, "a b", "a b c", "a b c"), (2, "fooBar", "x", "foo bar")], "example_id long, src string, ref string, pred string")
    meteor = spark.createDataFrame([(1, 1.0), (2, 0.5)], "example_id long, meteor double")
    got = metrics.evaluation_summary(rows, True, meteor=meteor).first()
    assert (got.acc_top_1, got.copy_pct, got.meteor, got.code_bleu) == (50.0, 50.0, 75.0, -1.0)
    assert metrics.evaluation_summary(rows, False).first().meteor == -1.0
    assert metrics.evaluation_summary(rows.limit(0), False).first().examples == 0


def test_code_metric_parts(spark):
    edges = spark.createDataFrame(
        [(1, s, p, v, "comesFrom", sv, sp) for s, names in (("ref", "abz"), ("hyp", "xyq")) for p, v, sv, sp in ((0, names[0], [], []), (1, names[1], [names[0]], [0]), (2, names[2], [], []))],
        "example_id long, side string, pos int, var string, relation string, src_vars array<string>, src_pos array<int>",
    )
    normal = {(r.side, r.edge) for r in structure.normalize_dataflow(structure.merge_dataflow(edges)).collect()}
    assert normal == {(s, e) for s in ("ref", "hyp") for e in ("comesFrom var_0", "comesFrom var_0 var_1")}
    assert tuple(structure.dataflow_counts(edges).first()) == (1, 2, 2)
    trees = spark.createDataFrame([(1, "ref", "(a)"), (1, "ref", "(a)"), (1, "ref", "(b)"), (1, "hyp", "(a)")], "example_id long, side string, sexp string")
    assert tuple(structure.syntax_counts(trees).first()) == (1, 2, 3)
    rows = spark.createDataFrame([(1, "if a b c", "if a b c")], "example_id long, ref string, pred string")
    whole = structure.code_bleu(structure.recall_stats(rows), trees, edges.limit(0)).first()
    assert (whole.ngram, whole.weighted, whole.dataflow) == (1.0, 1.0, None)
    assert whole.code_bleu == pytest.approx(100 * (1 + 1 + 2 / 3) / 3, abs=1e-4)


JAVA = "@Ann class A<B<C>> { /* c */ String s = \"a // b\"; char c = 'x'; int i = 0x1F_L; double d = 1.5e-3f; void f(int... a) { i >>>= 2; } // end\n}"


def test_java_tokens(spark):
    df = spark.createDataFrame([(1, JAVA), (2, 'String s = "open'), (3, None), (4, "")], "id long, c string")
    table = code.java_token_table(df, "id", "c")
    got = {r.token: r.kind for r in table.where("id = 1").collect()}
    for token, kind in (('"a // b"', "string"), ("'x'", "string"), ("0x1F_L", "number"), ("1.5e-3f", "number"), ("...", "separator"), (">>>=", "operator"), ("int", "basic_type"), ("class", "keyword"), ("Ann", "identifier"), ("@", "annotation")):
        assert got[token] == kind, (token, got.get(token))
    assert not any(t.startswith("/") for t in got)
    words = [r.token for r in table.where("id = 1").orderBy("pos").collect()]
    assert words[4:10] == ["<", "B", "<", "C", ">", ">"]
    whole = {r.id: r.t for r in df.select("id", code.tokenize_java(F.col("c")).alias("t")).collect()}
    assert whole[2] == [] and whole[3] is None and whole[4] == [] and whole[1] == words


def test_code_columns(spark):
    one = lambda column, value: spark.createDataFrame([(value,)], "c string").select(column.alias("v")).first().v
    c = F.col("c")
    assert one(code.remove_comments(c), 'a = "x // y"; // z\n\n/* q\nr */ b') == 'a = "x // y";  \n  b'
    assert one(code.remove_java_annotation(c), "@ Override @ SuppressWarnings ( \"a\" ) void f ( )") == "void f ( )"
    assert one(code.java_function_name(T.tokens(c)), "static int f ( int a )") == "f"
    assert one(code.java_function_name(T.tokens(c)), "x") is None
    assert one(code.python_function_name(T.tokens(c)), "def g ( a )") == "g"
    args = one(code.java_arguments(T.tokens(c)), "void f ( final int [ ] a , String b ) { g ( c ) ; }")
    assert (args.types, args.names) == (["final int [ ]", "String"], ["a", "b"])
    args = one(code.java_arguments(T.tokens(c)), "void f ( ) { }")
    assert (args.types, args.names) == (["None"], ["None"])
    assert one(code.is_python3(c), "for i in xrange ( 3 )") is False and one(code.is_python3(c), "print ( 3 )") is True


def test_token_labels(spark):
    df = spark.createDataFrame([("a b c d".split(), "a x c d e".split()), ("a b".split(), ["a"])], "o array<string>, n array<string>")
    df = df.withColumn("ops", plans.edit_opcodes("o", "n"))
    got = [r.v for r in df.select(F.array_join(plans.edit_token_labels(F.col("ops"), F.col("o"), F.col("n")), " ").alias("v")).collect()]
    assert got == ["<KEEP> a <REPLACE_OLD> b <REPLACE_NEW> x <KEEP> c <KEEP> d <INSERT> e", "<KEEP> a <DELETE> b"]
