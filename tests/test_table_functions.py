"""Table functions called from SQL."""

from palimpsest.operators import table_functions


def test_scorer_sees_whole_groups_in_parts(spark):
    """A group beyond a part, nulls, another column order and other columns, and scores that are no numbers."""
    def make():
        def lengths(a, b):
            assert len(a) <= 1024
            return a.map(lambda x: float("nan") if x is None else len(x)) + b.map(lambda x: 0 if x is None else len(x))

        return lengths

    table_functions.register_scorer(spark, "lengths_of", make)
    n = table_functions.CHUNK * 2 + 5
    rows = [("q", "a" * (k % 7), k, 1, None if k % 5 == 0 else "bb") for k in range(n)] + [("q", None, 0, None, "x"), ("q", "", 1, 3, "")]
    spark.createDataFrame(rows, "extra string, a string, beam_rank int, example_id long, b string").createOrReplaceTempView("to_score")
    got = spark.sql("select * from lengths_of(table(to_score) partition by example_id order by beam_rank)").collect()
    want = {(e, r): None if a is None else len(a) + len(b or "") for _, a, r, e, b in rows}
    assert len(got) == len(rows) and {(x.example_id, x.beam_rank): x.score for x in got} == want
    assert spark.sql("select * from lengths_of(table(select * from to_score where false) partition by example_id)").count() == 0


def test_tokens_as_rows_stay_native(spark):
    table_functions.register_tokens(spark)
    spark.createDataFrame([(1, " a\tb  c d "), (2, ""), (3, None)], "id long, t string").createOrReplaceTempView("texts")
    df = spark.sql("select id, pos, token from texts, lateral text_tokens(t)")
    assert sorted(map(tuple, df.collect())) == [(1, k, c) for k, c in enumerate("abcd")]
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
