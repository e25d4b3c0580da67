"""Functions of tokenised source files as tables. Where a function may start and end is found by windows over the token
table; which of them are outermost is a fold over one file's candidates. Only Python's tokenizer is an Arrow function."""

from __future__ import annotations

import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.code import is_python3, remove_java_annotation
from palimpsest.functions.literals import escape_literal
from palimpsest.operators.nesting import nested_spans, outermost, span_nesting_depth
from palimpsest.sources.shared import cut

#: What a Java function may follow; a comment right before it belongs to it.
BOUNDS = ("*/", "ENDCOM", ";", "}", "{")
OPENERS = {"*/": "/*", "ENDCOM": "//"}

_KEY = ["row"]


def _tokens(rows: DataFrame, key: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """Files with a number for each row, and their token table. Files are kept, so that both have the same numbers."""
    files = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words.alias("w")))
    return files, files.select("row", F.posexplode("w").alias("pos", "word"))


def _cut_out(files: DataFrame, candidates: DataFrame, start, key: str) -> DataFrame:
    """(key, idx, f): the tokens of the outermost candidates of each file. start: from a candidate and the end of the
    function before to where it begins."""
    each = candidates.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("from", *[c for c in candidates.columns if c not in ("row", "from")]))).alias("c"))
    found = files.join(each, "row").select("key", "w", F.posexplode(outermost(F.col("c"))).alias("idx", "x"))
    at = start(F.col("x.c"), F.col("x.floor"))
    return found.select(F.col("key").alias(key), "idx", F.slice("w", at + 1, F.col("x.c.end") - at).alias("f"))


def java_spans(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates: the end of a bracketed list, perhaps with a throws clause of one name, before a block. (row, from, end,
    bound, opener): the list's last bracket, the end of the block or the file, the last bound up to the bracket and, if
    that ends a comment, where the comment begins."""
    w = Window.partitionBy(*_KEY).orderBy("pos")
    word = F.col("word")
    nested = span_nesting_depth(tokens, _KEY, word == "{", word == "}")
    # Behind the bracket: the block's first token, or a throws clause and then the block.
    ahead = lambda n: F.lead("word", n).over(w)
    body = F.when(ahead(1) == "{", 1).when((ahead(1) == "throws") & (ahead(3) == "{"), 3)
    last = lambda test: F.last(F.when(test, F.col("pos")), ignorenulls=True).over(w)
    begun = F.when(word == "*/", last(word == "/*")).when(word == "ENDCOM", last(word == "//"))
    marked = nested.withColumn("body", F.when(word == ")", F.col("pos") + body)).withColumn("begun", begun)
    bound = F.last(F.when(word.isin(*BOUNDS), F.struct("pos", "begun")), ignorenulls=True).over(w)
    lists = marked.withColumn("bound", bound).where("body is not null").select("row", F.col("pos").alias("from"), F.col("body").alias("pos"), "bound")
    blocks = nested_spans(nested, _KEY, word == "{").select("row", "pos", "end")
    found = lists.join(blocks, ["row", "pos"]).join(sizes, "row")
    return found.select("row", "from", F.coalesce(F.col("end") + 1, "size").alias("end"), F.col("bound.pos").alias("bound"), F.col("bound.begun").alias("opener"))


def python_spans(tokens: DataFrame) -> DataFrame:
    """Candidates (row, from, end): every def, and behind the DEDENT that balances it, null if nothing does."""
    word = F.col("word")
    nested = span_nesting_depth(tokens, _KEY, word == "INDENT", word == "DEDENT")
    end = F.last(F.when(word == "DEDENT", F.col("pos") + 1), ignorenulls=True)
    after = Window.partitionBy(*_KEY, "depth").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # A def stands at the depth to which its block's DEDENT falls back.
    return nested.where(word.isin("def", "DEDENT")).withColumn("end", end.over(after)).where(word == "def").select("row", F.col("pos").alias("from"), "end")


def java_function_table(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, idx, function, standalone): the functions of a file's tokens; standalone ones are static, the others belong
    to a class. Leading annotations go."""
    files, tokens = _tokens(rows, key, words)

    def start(c: Column, floor: Column) -> Column:
        """Behind the last bound, where its comment begins, or behind the function before."""
        inside = c["bound"] >= floor
        return F.when(inside & (c["opener"] >= floor), c["opener"]).when(inside, c["bound"] + 1).otherwise(floor)

    f = _cut_out(files, java_spans(tokens, files.select("row", F.size("w").alias("size"))), start, key)
    # The head ends at the first block; a comment's braces count as they stand.
    head = F.slice("f", 1, F.array_position("f", "{").cast("int"))
    return f.select(key, "idx", remove_java_annotation(F.array_join("f", " ")).alias("function"), F.array_contains(head, "static").alias("standalone"))


def python_function_table(rows: DataFrame, key: str, words: Column) -> DataFrame:
    """(key, idx, function, standalone): methods, whose first argument is self, are not standalone. Functions without
    brackets or with a sign of version 2 go."""
    files, tokens = _tokens(rows, key, words)
    f = _cut_out(files, python_spans(tokens), lambda c, floor: c["from"], key).withColumn("at", F.array_position("f", "(").cast("int")).where("at > 0")
    out = f.select(key, "idx", F.array_join("f", " ").alias("function"), (F.coalesce(F.get("f", F.col("at")), F.lit("")) != "self").alias("standalone"))
    return out.where(is_python3(F.col("function")))


def python_parts(text: str, keep_comments: bool) -> list[tuple[str, str]]:
    """(kind, token) of a Python text: kind is comment, string or other; none for a text that is no Python."""
    short = lambda t: len(re.sub(r"\W", "", t)) < 2
    parts: list[tuple[str, str]] = []
    gone = False
    try:
        for t in tokenize.tokenize(io.BytesIO(text.replace("\\r", "").encode()).readline):
            doc = t.type == tokenize.STRING and t.string == t.line.strip()
            if t.type == tokenize.NEWLINE:
                # The line end of a docstring that went goes too.
                parts += [] if gone else [("other", "NEW_LINE")]
                gone = False
            elif t.type == tokenize.COMMENT or doc:
                if keep_comments and not short(t.string):
                    parts.append(("comment", t.string))
                else:
                    gone |= doc
            elif t.type == tokenize.DEDENT and parts and parts[-1][1] == "INDENT":
                parts.pop()
            elif t.type in (tokenize.INDENT, tokenize.DEDENT):
                parts.append(("other", tokenize.tok_name[t.type]))
            elif t.type not in (tokenize.ENCODING, tokenize.NL, tokenize.ENDMARKER):
                parts.append(("string" if t.type == tokenize.STRING else "other", t.string))
    except (tokenize.TokenError, SyntaxError, UnicodeError):
        return []
    return parts


def tokenize_python(c: Column, keep_comments: bool = False) -> Column:
    """Tokens with NEW_LINE, INDENT and DEDENT; docstrings and comments only on request, literals escaped; none for a
    text that is no Python. Null gives null."""
    @F.pandas_udf("array<struct<kind:string,token:string>>")
    def parts(column: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [dict(zip(("kind", "token"), p, strict=True)) for p in python_parts(t, keep_comments)] for t in column])

    written = F.transform(parts(c), lambda p: F.when(p["kind"] == "comment", escape_literal(p["token"], "python", True)).when(p["kind"] == "string", escape_literal(p["token"], "python")).otherwise(p["token"]))
    return F.filter(written, lambda t: t != "")
