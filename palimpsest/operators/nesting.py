"""Nesting of token tables by windows: depths, spans from an opening token to its closing one, and parents.

The running balance of a text's opening and closing tokens gives each a level: the balance behind an opening one, that
before a closing one. Between two opening tokens of one level there is always a closing one of that level, so the next
smaller balance, which a scan would look for, is simply the next row of the same level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def span_nesting_depth(tokens: DataFrame, key: list[str], opens: Column, closes: Column, pos: str = "pos") -> DataFrame:
    """Adds depth, the balance behind each token, and level, which is null for tokens that neither open nor close.

    Tokens are ordered by pos inside each key. Closing tokens without an opening one make the balance negative; null
    conditions count as false. Columns named depth or level are replaced.
    """
    step = F.when(F.coalesce(opens, F.lit(False)), 1).when(F.coalesce(closes, F.lit(False)), -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy(*key).orderBy(pos))
    return tokens.withColumn("depth", depth).withColumn("level", F.when(step == 1, F.col("depth")).when(step == -1, F.col("depth") + 1))


def nested_spans(nested: DataFrame, key: list[str], opens: Column, pos: str = "pos") -> DataFrame:
    """The opening tokens with end, the place of the closing token of each, null if it is never closed."""
    at = nested.where(F.col("level").isNotNull())
    end = F.lead(pos).over(Window.partitionBy(*key, "level").orderBy(pos))
    return at.withColumn("end", end).where(F.coalesce(opens, F.lit(False)))


def nested_parents(spans: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Adds parent, the place of the innermost span around each, null for outermost ones. spans: opening tokens with level.

    Each span offers itself on its own level and asks on the one around it, where the last offer before it is its parent."""
    rows = spans.withColumn("ask", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("at", F.when(F.col("ask"), F.col("level") - 1).otherwise(F.col("level")))
    before = Window.partitionBy(*key, "at").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("parent", F.last(F.when(~F.col("ask"), F.col(pos)), ignorenulls=True).over(before))
    return found.where("ask").drop("ask", "at")


def outermost(candidates: Column) -> Column:
    """Of an array of structs with from and end, in order of from, those that begin behind the end of the last one taken.

    A struct's ``floor`` is that end, 0 for the first. An end of null takes everything from there and is left out itself."""
    none = F.array().cast("array<struct<floor:int,nth:int>>")
    start = F.struct(F.lit(0).alias("floor"), F.lit(False).alias("over"), none.alias("taken"))

    def step(state: Column, x: Column) -> Column:
        c = x["c"]
        fits = ~state["over"] & (c["from"] >= state["floor"])
        taken = F.when(fits & c["end"].isNotNull(), F.concat(state["taken"], F.array(F.struct(state["floor"].alias("floor"), x["nth"].alias("nth"))))).otherwise(state["taken"])
        return F.struct(
            F.when(fits, F.coalesce(c["end"], state["floor"])).otherwise(state["floor"]).alias("floor"),
            (state["over"] | fits & c["end"].isNull()).alias("over"), taken.alias("taken"),
        )

    numbered = F.transform(candidates, lambda c, i: F.struct(c.alias("c"), i.alias("nth")))
    return F.transform(F.aggregate(numbered, start, step)["taken"], lambda t: F.struct(t["floor"].alias("floor"), F.get(candidates, t["nth"]).alias("c")))
