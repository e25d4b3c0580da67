"""Replay of code plans that name the whole old text, with words that repeat."""

import difflib
import random

from palimpsest.operators import plans

#: Words that repeat.
OLD, NEW = "a x x b x c".split(), "n x m x b c".split()


def _plan(old, new):
    spans = {"equal": ("<KEEP>", None, "<KEEP_END>"), "delete": ("<DELETE>", None, "<DELETE_END>"), "insert": (None, "<INSERT>", "<INSERT_END>"), "replace": ("<REPLACE_OLD>", "<REPLACE_NEW>", "<REPLACE_END>")}
    out = []
    for tag, i, j, k, n in difflib.SequenceMatcher(None, old, new).get_opcodes():
        first, second, end = spans[tag]
        out += [*([first, *old[i:j]] if first else []), *([second, *new[k:n]] if second else []), end]
    return out


def test_whole_plans_replay_exactly_with_few_words():
    rnd = random.Random(5)
    for _ in range(3000):
        old, new = rnd.choices("abcd", k=rnd.randint(0, 14)), rnd.choices("abcde", k=rnd.randint(0, 14))
        assert plans.replay_code(old, _plan(old, new)) == " ".join(new), (old, new)


def test_partial_plans_still_go_by_anchors():
    assert plans.code_whole(OLD, "<DELETE> b <DELETE_END>".split()) is None
    assert plans.code_whole(OLD, [*_plan(OLD, NEW), "<DELETE>", "c", "<DELETE_END>"]) is None
    assert plans.replay_code("a b a".split(), "<DELETE> a <DELETE_END>".split()) == "b a"


def test_code_plan_queries_give_the_target(spark, tmp_path):
    import oracle
    from palimpsest import catalog

    rows = [(1, 0, "user", "d d d c b"), (1, 1, "assistant", "d e d c"), (2, 0, "user", "x"), (2, 1, "assistant", "y x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / "c").glob("*.parquet")) if t == "conversations" else f"/root/testdata/sf0.001/{t}.parquet")
    for name in ("apply_edit_plan", "replay_code_plan"):
        oracle.compare(catalog.queries()[name](spark, str(tmp_path)), catalog.oracle_sql()[name], str(tmp_path))
