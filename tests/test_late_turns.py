"""Turns from 100 on, and rows of the same turn: queries on pairs of turns and their twins name and pair them alike."""

import oracle
import pytest

from palimpsest import catalog

ROWS = [(7, t, ("user", "assistant")[t % 2], " ".join("abcdefg"[(t * k) % 7] for k in range(1, 9 + t % 5))) for t in [*range(6), *range(96, 131), 398, 399]]
SAME = [(3, 0, "user", "x y z"), (3, 1, "assistant", "y z"), (3, 1, "assistant", "x z"), (3, 1, "user", "z z y"), (3, 1, "assistant", "z y y"), (3, 2, "assistant", "y")]


@pytest.fixture
def tables(spark, tmp_path):
    # The last rows first: their order decides nothing.
    rows = [*ROWS, *SAME, (8, 0, "user", "q r"), (8, 1, "assistant", "r r")][::-1]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / "c").glob("*.parquet")) if t == "conversations" else f"/root/testdata/sf0.001/{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["replay_code_plan", "apply_edit_plan", "rerank_best", "split_dataset", "marker_classes"])
def test_twins_agree_on_late_and_equal_turns(spark, tables, name):
    oracle.compare(catalog.queries()[name](spark, tables), catalog.oracle_sql()[name], tables)
