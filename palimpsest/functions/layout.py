"""Token lists back as laid-out source text; all native.

A text is put into lines by what its tokens say, the lines' depths follow from those before them, and literals and
comments get back the signs that escape_literal named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.literals import BLANK, END, NEW_LINE, TAB

#: Literals and comments of laid-out text, and what lies between, by language.
_PIECES = {
    "java": r"""//[^\n]*|/\*(?s:.*?)\*/|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'|[^/'"]+|[/'"]""",
    "python": r"""#[^\n]*|'{3}(?s:.*?)'{3}|"{3}(?s:.*?)"{3}|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'|[^#'"]+|['"]""",
}
_HELD = {"java": r"""^(?://|/\*|".*"$|'.*'$)""", "python": r"""^(?:#|(?s:".*")$|(?s:'.*')$)"""}


def restore_literals(c: Column, language: str) -> Column:
    """A laid-out text whose literals and comments have their blanks, tabs and line ends back."""
    def back(p: Column) -> Column:
        for name, sign in ((NEW_LINE, "\n"), (TAB, "\t"), (" ", ""), (BLANK, " ")):
            p = F.replace(p, F.lit(name), F.lit(sign))
        return p

    pieces = F.regexp_extract_all(c, F.lit(f"({_PIECES[language]})"), 1)
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(_HELD[language]), back(p)).otherwise(p)), "")


def _indented(lines: Column, shift_before: Column | object, shift_after: object, text: object, unit: str) -> Column:
    """The lines, each behind as many units as its depth: what the lines so far leave, no less than none, changed by
    shift_before(line) for the line itself and by shift_after(line) for those behind it."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        depth = F.greatest(s["depth"] + shift_before(line), F.lit(0))
        out = F.concat(s["out"], F.array(F.concat(F.repeat(F.lit(unit), depth), text(line))))
        return F.struct(F.greatest(depth + shift_after(line), F.lit(0)).cast("int").alias("depth"), out.alias("out"))

    return F.aggregate(lines, start, step, lambda s: F.array_join(s["out"], "\n"))


def detokenize_java(words: Column) -> Column:
    """Source text of escaped tokens: a line ends behind ; { } and comments, but not between a brace and the ; or , behind
    it nor between a brace and a string; two spaces for each open block."""
    none = F.lit("")
    near = lambda i, k: F.coalesce(F.get(words, i + k), none) if k > 0 else F.when(i > 0, F.get(words, F.greatest(i + k, F.lit(0)))).otherwise(none)

    def piece(w: Column, i: Column) -> Column:
        after_string, before_string = near(i, -1).endswith('"'), near(i, 1).startswith('"')
        joined = (w == "}") & near(i, 1).isin(";", ",")
        ends = w.isin(";", "*/", END) | ((w == "{") & ~after_string) | ((w == "}") & ~before_string & ~joined)
        return F.concat(F.when(w == END, "").otherwise(w), F.when(ends, "\n").when(joined, "").otherwise(" "))

    lines = F.transform(F.split(F.array_join(F.transform(words, piece), ""), "\n"), lambda x: F.trim(x))
    closes, opens = (lambda x: x.startswith("}")), (lambda x: x.endswith("{"))
    text = _indented(lines, lambda x: F.when(closes(x), -1).otherwise(0), lambda x: F.when(opens(x) & ~closes(x), 1).otherwise(0), lambda x: x, "  ")
    for apart, joined in (("> > >", ">>>"), ("> >", ">>"), ("< <", "<<")):
        text = F.replace(text, F.lit(apart), F.lit(joined))
    return restore_literals(text, "java")


def detokenize_python(c: Column) -> Column:
    """Source text of joined tokens: lines at NEW_LINE, four spaces for every INDENT that no DEDENT has closed."""
    lines = F.transform(F.split(F.replace(c, F.lit(END), F.lit("NEW_LINE")), "NEW_LINE"), lambda x: F.trim(x))
    dedents = lambda x: F.when(x.startswith("DEDENT"), F.size(F.split(x, "DEDENT")) - 1).otherwise(0)
    indents = lambda x: F.when(x.startswith("INDENT "), 1).otherwise(0)
    text = lambda x: F.trim(F.replace(F.regexp_replace(x, "^INDENT ", ""), F.lit("DEDENT"), F.lit("")))
    out = restore_literals(_indented(lines, lambda x: indents(x) - dedents(x), lambda _: F.lit(0), text, "    "), "python")
    for apart, joined in ((". ", "."), (" .", "."), ("import.", "import ."), ("from.", "from ."), ("> >", ">>"), ("< <", "<<")):
        out = F.replace(out, F.lit(apart), F.lit(joined))
    return out


def format_java_tokens(table: DataFrame, key: str) -> DataFrame:
    """(key, text): a token table as text in blocks of four spaces. table: key, pos, token, kind (java_token_table).

    A closing brace goes to a line of its own once the next token is known, or the end. Depths are running sums.
    """
    order = Window.partitionBy(key).orderBy("pos")
    word = F.col("kind").isin("string", "number", "boolean", "null", "keyword", "modifier", "basic_type", "identifier")
    brace = F.when(F.col("token") == "{", 1).when(F.col("token") == "}", -1).otherwise(0)
    t = table.withColumn("word", word).withColumn("before", F.coalesce(F.sum(brace).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("prev", F.lag("token").over(order)).withColumn("prev_word", F.coalesce(F.lag("word").over(order), F.lit(False)))
    t = t.withColumn("last", F.lead("token").over(order).isNull())
    line = lambda depth: F.concat(F.lit("\n"), F.repeat(F.lit(" "), 4 * F.greatest(depth, F.lit(0))))
    depth, token = F.col("before").cast("int"), F.col("token")
    closing = F.when(F.col("prev") == "}", F.concat(line(depth), F.lit("}"), F.when(F.col("word"), line(depth)).otherwise(""))).otherwise("")
    own = (
        F.when(token == "{", F.concat(F.lit(" {"), line(depth + 1))).when(token == "}", "").when(token == ",", ", ")
        .when(F.col("word"), F.concat(F.when(F.col("prev_word"), " ").otherwise(""), token)).when(F.col("kind") == "operator", F.concat(F.lit(" "), token, F.lit(" ")))
        .when(token == ";", F.concat(F.lit(";"), line(depth))).otherwise(token)
    )
    end = F.when(F.col("last"), F.when(token == "}", "\n}\n").otherwise("\n")).otherwise("")
    pieces = t.select(key, "pos", F.concat(closing, own, end).alias("piece"))
    whole = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return pieces.groupBy(key).agg(F.array_join(F.transform(whole, lambda x: x["piece"]), "").alias("text"))
