"""Words with runs of one letter: comments are cut to five of them, literals and doc comments are not; the twins say so too."""

import oracle
import pytest

from palimpsest import catalog

WORDS = ["llll", "lllll", "rrrrrr", "allllllleee", "vvvv", "vvvvv", "vvvvvvvvvvvv", "aaaaaabbbbbbbaaaaaaa", "plain"]


@pytest.fixture
def tables(spark, tmp_path):
    rows = [(k, 0, "user", " ".join(WORDS[(k + j) % len(WORDS)] for j in range(1 + k % 5))) for k in range(2 * len(WORDS))]
    rows += [(k, 1, "assistant", "yes") for k, *_ in rows]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    for t in oracle.TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(next((tmp_path / "c").glob("*.parquet")) if t == "conversations" else f"/root/testdata/sf0.001/{t}.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["literals", "tokenize_java"])
def test_twins_cut_runs_in_comments(spark, tables, name):
    """the twin held the words of a comment for whole."""
    oracle.compare(catalog.queries()[name](spark, tables), catalog.oracle_sql()[name], tables)


def test_only_comments_are_cut(spark, tables):
    found = {r.example_id: r for r in catalog.queries()["literals"](spark, tables).collect()}
    row = found[200]  # rrrrrr allllllleee vvvv
    assert (row.literal, row.comment) == ('" vrrrrrr ▁ ▁ vallllllleee "', "// ▁ vrrrrr ▁ - - - - - ENDCOM")
    assert row.doc == "/* says vrrrrrr vallllllleee */ <INLINE> // see vvvvv ENDCOM"
    assert found[500].comment == "// ▁ vvvvv ▁ - - - - - ENDCOM"
