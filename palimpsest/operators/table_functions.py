"""Table functions for SQL: tokens as rows, and supplied scorers over the groups of a partitioned table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from palimpsest.functions.text import BLANKS

#: Rows of a group that are scored at a time; a group may have any number.
CHUNK = 1024


def register_tokens(spark: SparkSession, name: str = "text_tokens") -> None:
    """text_tokens(text): a row (pos, token) for each token, none for null; stays native in the plans that use it."""
    split = BLANKS.replace("\\", "\\\\")
    spark.sql(
        f"""create or replace temporary function {name}(t string) returns table (pos int, token string)
        return select pos, col as token from posexplode(array_remove(split({name}.t, '{split}'), ''))"""
    )


def register_scorer(spark: SparkSession, name: str, make: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]) -> None:
    """name(TABLE(rows) PARTITION BY example_id): (example_id, beam_rank, score) of rows (example_id, beam_rank, a, b), in any
    column order. make is called once for each group, in the worker; the scorer takes and gives pandas series, a part of
    a group at a time. Other columns are left out; a null text is given to the scorer as it is."""

    class Scorer:
        def __init__(self) -> None:
            self.score, self.held = make(), []

        def _scored(self) -> Iterator[tuple]:
            if self.held:
                found = self.score(pd.Series([r[2] for r in self.held], dtype=object), pd.Series([r[3] for r in self.held], dtype=object))
                yield from ((r[0], r[1], None if pd.isna(s) else float(s)) for r, s in zip(self.held, found, strict=True))
                self.held = []

        def eval(self, row: Row) -> Iterator[tuple]:
            self.held.append((row["example_id"], row["beam_rank"], row["a"], row["b"]))
            if len(self.held) >= CHUNK:
                yield from self._scored()

        def terminate(self) -> Iterator[tuple]:
            yield from self._scored()

    spark.udtf.register(name, udtf(Scorer, returnType="example_id long, beam_rank int, score double"))
