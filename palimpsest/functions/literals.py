"""Literals and comments of source code as runs of tokens, and escapes; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.code import java_kind, java_tokens

# Signs that are protected while a literal is tokenised, by language and in this order.
PROTECTED = {
    "java": (("//", "STOKEN0"), ("/*", "STOKEN1"), ("*/", "STOKEN2"), ("/**", "STOKEN3"), ("**/", "STOKEN4"), ('"""', "STOKEN5"), ("\\n", "STOKEN6")),
    "python": (("#", "STOKEN0"), ("\\n", "STOKEN1"), ('"""', "STOKEN2"), ("'''", "STOKEN3")),
}
BLANK, NEW_LINE, TAB, END = "▁", "STRNEWLINE", "TABSYMBOL", "ENDCOM"


def decode_unicode_escapes(c: Column) -> Column:
    r"""\uXXXX, with any number of u, as the character it stands for; an escaped backslash before it stays as it is."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\\u+[0-9a-fA-F]{4}|\\(?s:.)|[^\\]+|\\)"), 1)
    # Neighbouring escapes are decoded together, so that the two halves of a surrogate pair meet.
    runs = F.regexp_extract_all(F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\\u"), F.concat(F.lit("\u0001"), F.right(p, F.lit(4)))).otherwise(F.concat(F.lit("\u0002"), p))), ""), F.lit("((?:\u0001[0-9a-fA-F]{4})+|\u0002[^\u0001\u0002]*)"), 1)
    decoded = lambda r: F.decode(F.unhex(F.replace(r, F.lit("\u0001"), F.lit(""))), "UTF-16BE")
    return F.array_join(F.transform(runs, lambda r: F.when(r.startswith("\u0001"), decoded(r)).otherwise(F.substring(r, 2, 2147483647))), "")


def international_tokens(c: Column) -> Column:
    """Punctuation apart from what is no number, symbols apart from everything; single spaces."""
    c = F.regexp_replace(c, r"(\P{N})(\p{P})", "$1 $2 ")
    c = F.regexp_replace(c, r"(\p{P})(\P{N})", " $1 $2")
    c = F.regexp_replace(c, r"(\p{S})", " $1 ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def enough_words(c: Column) -> Column:
    """Whether a comment has two word characters at least."""
    return F.length(F.regexp_replace(c, r"(?U)\W", "")) >= 2


def escape_literal(c: Column, language: str, is_comment: bool = False) -> Column:
    """A literal or comment as tokens between single spaces: blanks, tabs and line ends get names, a line comment ends
    with a mark; in comments runs of one character are cut to five, and a comment without two word characters is empty."""
    signs = PROTECTED[language]
    t = c
    if is_comment:
        t = F.regexp_replace(F.regexp_replace(t, " +", " "), r"(.)\1{4,}", "$1$1$1$1$1")
        kept = enough_words(t)
    t = F.replace(t, F.lit(" "), F.lit(f" {BLANK} "))
    for sign, name in signs:
        t = F.replace(t, F.lit(sign), F.lit(f" {name} "))
    t = F.when(t.startswith(" STOKEN0"), F.concat(F.regexp_replace(t, r"\n\z", ""), F.lit(f" {END}"))).otherwise(t)
    t = F.replace(F.replace(t, F.lit("\n"), F.lit(f" {NEW_LINE} ")), F.lit("\t"), F.lit(f" {TAB} "))
    t = international_tokens(F.regexp_replace(t, " +", " "))
    for sign, name in signs:
        t = F.replace(t, F.lit(name), F.lit(sign))
    t = F.replace(t, F.lit("\r"), F.lit(""))
    return F.when(kept, t).when(c.isNotNull(), "") if is_comment else t


def java_escaped_tokens(c: Column, keep_comments: bool = False) -> Column:
    """Tokens with literals, and comments on request, as escape_literal writes them; none for a malformed text."""
    found = java_tokens(decode_unicode_escapes(c), keep_comments)
    written = F.transform(found, lambda t: F.when(java_kind(t) == "comment", escape_literal(t, "java", True)).when(java_kind(t) == "string", escape_literal(t, "java")).otherwise(t))
    return F.when(F.exists(found, lambda t: java_kind(t) == "stray"), F.array().cast("array<string>")).otherwise(F.filter(written, lambda t: t != ""))


def _doc_pair(c: Column, doc: Column, without: Column) -> Column:
    """struct of text and doc out of a function's block comments and its text without them; both empty without a block
    comment or with fewer than five word characters in all comments."""
    line = r"((?://|#).*?ENDCOM)"
    inline = F.regexp_extract_all(without, F.lit(line), 1)
    text = F.regexp_replace(F.regexp_replace(without, line, ""), r"(?U)\s+", " ")
    whole = F.concat(doc, F.array_join(F.transform(inline, lambda x: F.concat(F.lit(" <INLINE> "), x)), ""))
    words = F.length(F.regexp_replace(F.replace(F.replace(whole, F.lit("<INLINE>"), F.lit("")), F.lit(END), F.lit("")), r"(?U)\W", ""))
    good = (doc != "") & (words >= 5)
    return F.struct(F.when(good, text).otherwise("").alias("text"), F.when(good, whole).otherwise("").alias("doc"))


def java_doc_pair(c: Column) -> Column:
    """struct(text, doc): a tokenised function without comments; its block comments, then the line comments, each
    behind <INLINE>."""
    block = r"(/\*(?s:.*?)\*/) "
    return _doc_pair(c, F.array_join(F.regexp_extract_all(c, F.lit(block), 1), " "), F.regexp_replace(c, block, ""))


def python_doc_pair(c: Column) -> Column:
    """The same with docstrings, which stand first in a block."""
    block = "(: NEW_LINE INDENT )('''(?s:.*?)'''|\"\"\"(?s:.*?)\"\"\")( NEW_LINE)"
    return _doc_pair(c, F.array_join(F.regexp_extract_all(c, F.lit(block), 2), " "), F.regexp_replace(c, block, "$1$3"))
