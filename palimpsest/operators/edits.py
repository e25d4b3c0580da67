"""Edit opcodes between token arrays, and the plans rendered from them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.sources.shared import small_batches

OPCODES = "array<struct<tag:string,o_start:int,o_end:int,n_start:int,n_end:int>>"


def edit_opcodes(old: Column | str, new: Column | str) -> Column:
    """Opcodes of the sequence matcher, its rule on popular tokens included; null if a side is null."""

    def one(a, b):
        if a is None or b is None:
            return None
        found = difflib.SequenceMatcher(None, list(a), list(b)).get_opcodes()
        return [dict(zip(("tag", "o_start", "o_end", "n_start", "n_end"), x, strict=True)) for x in found]

    # Token arrays are wide, and a worker holds a batch of them as Python lists.
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)

    @F.pandas_udf(OPCODES)
    def column(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(olds, news, strict=True)])

    return column(old, new)


def _part(words: Column, start: Column, end: Column) -> Column:
    return F.slice(words, start + 1, end - start)


def _render(op: Column, old: Column, new: Column, kinds: dict[str, Column]) -> Column:
    choice = None
    for tag, value in kinds.items():
        choice = F.when(op["tag"] == tag, value) if choice is None else choice.when(op["tag"] == tag, value)
    return choice


def code_edit_plan(ops: Column, old: Column, new: Column) -> Column:
    """Marked spans for all opcodes: kept, replaced, inserted, deleted."""
    lit = lambda *words: F.array(*[F.lit(w) for w in words])

    def one(op: Column) -> Column:
        o, n = _part(old, op["o_start"], op["o_end"]), _part(new, op["n_start"], op["n_end"])
        return _render(op, old, new, {
            "equal": F.concat(lit("<KEEP>"), o, lit("<KEEP_END>")),
            "replace": F.concat(lit("<REPLACE_OLD>"), o, lit("<REPLACE_NEW>"), n, lit("<REPLACE_END>")),
            "insert": F.concat(lit("<INSERT>"), n, lit("<INSERT_END>")),
            "delete": F.concat(lit("<DELETE>"), o, lit("<DELETE_END>")),
        })

    return F.flatten(F.transform(ops, one))


def edit_commands(ops: Column, old: Column, new: Column) -> Column:
    """For kept, deleted and replaced old tokens the marker alone, for inserted and new tokens marker and token."""
    def one(op: Column) -> Column:
        o, n = _part(old, op["o_start"], op["o_end"]), _part(new, op["n_start"], op["n_end"])
        alone = lambda mark: F.transform(o, lambda _: F.lit(mark))
        both = lambda mark: F.flatten(F.transform(n, lambda t: F.array(F.lit(mark), t)))
        return _render(op, old, new, {
            "equal": alone("<KEEP>"), "delete": alone("<DELETE>"), "insert": both("<INSERT>"),
            "replace": F.concat(alone("<REPLACE_OLD>"), both("<REPLACE_NEW>")),
        })

    return F.flatten(F.transform(ops, one))


def replay_opcodes(ops: Column, old: Column, new: Column) -> Column:
    """The new sequence from kept old tokens and the plan's new ones."""
    return F.flatten(F.transform(ops, lambda op: F.when(op["tag"] == "equal", _part(old, op["o_start"], op["o_end"])).otherwise(_part(new, op["n_start"], op["n_end"]))))


def full_replace_plan(old: Column, new: Column) -> Column:
    return F.concat(F.array(F.lit("<REPLACE_OLD>")), old, F.array(F.lit("<REPLACE_NEW>")), new, F.array(F.lit("<REPLACE_END>")))


def coarse_diff(ops: Column, old: Column, new: Column) -> Column:
    """array of (kind, children) for the opcodes: a replacement's children are its old tokens, <REPLACE_NEW>, its new ones."""
    mark = lambda m: F.lit(f"<{m}>")

    def one(op: Column) -> Column:
        o, n = _part(old, op["o_start"], op["o_end"]), _part(new, op["n_start"], op["n_end"])
        kind = F.when(op["tag"] == "equal", mark("KEEP")).otherwise(F.concat(F.lit("<"), F.upper(op["tag"]), F.lit(">")))
        children = F.when(op["tag"] == "insert", n).when(op["tag"] == "replace", F.concat(o, F.array(mark("REPLACE_NEW")), n)).otherwise(o)
        return F.struct(kind.alias("kind"), children.alias("children"))

    return F.transform(ops, one)


def edit_neighbours(nodes: DataFrame, by: str = "example_id", order: str = "op_idx", kind: str = "kind") -> DataFrame:
    """Adds prev_kind and next_kind, the kinds of the nodes before and behind in the same example; null at its ends."""
    w = Window.partitionBy(by).orderBy(order)
    return nodes.withColumn("prev_kind", F.lag(kind).over(w)).withColumn("next_kind", F.lead(kind).over(w))
