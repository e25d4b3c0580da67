"""Column functions over texts and token arrays; all native."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks that separate tokens, as the inside of a character class; the same in every engine.
BLANK = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A run of them; the intersection's first part turns letters down at once.
BLANKS = rf"[\x{{9}}-\x{{20}}\x{{85}}-\x{{3000}}&&[{BLANK}]]+"

# The edit plan's markers.
EDIT_TOKENS = (
    "<REPLACE>", "<REPLACE_OLD>", "<REPLACE_NEW>", "<REPLACE_END>",
    "<REPLACE_OLD_KEEP_BEFORE>", "<REPLACE_NEW_KEEP_BEFORE>", "<REPLACE_OLD_KEEP_AFTER>", "<REPLACE_NEW_KEEP_AFTER>",
    "<REPLACE_OLD_DELETE_KEEP_BEFORE>", "<REPLACE_NEW_DELETE_KEEP_BEFORE>", "<REPLACE_OLD_DELETE_KEEP_AFTER>", "<REPLACE_NEW_DELETE_KEEP_AFTER>",
    "<INSERT>", "<INSERT_OLD>", "<INSERT_NEW>", "<INSERT_END>",
    "<INSERT_OLD_KEEP_BEFORE>", "<INSERT_NEW_KEEP_BEFORE>", "<INSERT_OLD_KEEP_AFTER>", "<INSERT_NEW_KEEP_AFTER>",
    "<DELETE>", "<DELETE_END>", "<KEEP>", "<KEEP_END>",
)


def normalize_ws(c: Column) -> Column:
    """Runs of blanks become one space, the ends lose theirs."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def tokens(c: Column) -> Column:
    """Tokens between blanks; an empty text has none."""
    return F.array_remove(F.split(c, BLANKS), "")


def split_raw_input(c: Column) -> tuple[Column, Column]:
    """(source, context): what stands before the first <s>, and the other parts joined by </s>; both trimmed."""
    parts = F.split(c, "<s>")
    return F.trim(parts[0]), F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "</s>"))


def split_model_input(c: Column, strip_context: bool = False) -> tuple[Column, Column]:
    """(source, context) of a rendered input: what stands before the first </s>, and the other parts joined by </s>. The
    text's ends and the source's right end lose their blanks, the context's left end only with strip_context."""
    parts = F.split(F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", ""), "</s>")
    rest = F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), "</s>")
    return F.regexp_replace(parts[0], f"{BLANKS}$", ""), F.regexp_replace(rest, f"^{BLANKS}", "") if strip_context else rest


def truncate_tokens(c: Column, most: int = 512) -> Column:
    """The first tokens of a text, joined by single spaces."""
    # A text that begins with a blank has an empty piece before its tokens; the last piece is the rest, left as it is.
    return F.array_join(F.slice(F.array_remove(F.split(c, BLANKS, most + 2), ""), 1, most), " ")


def render_model_input(source: Column, context: Column) -> Column:
    return F.concat_ws(" </s> ", source, context)


def render_edit_target(plan: Column, target: Column) -> Column:
    return F.concat(plan, F.lit(" <s> "), target)


def remove_keep_span(c: Column) -> Column:
    """Without <KEEP> ... <KEEP_END> blocks; an unclosed one goes to the end."""
    cut = F.regexp_replace(c, "(?s)<KEEP>.*?(<KEEP_END>|$)", "")
    return normalize_ws(F.replace(cut, F.lit("<KEEP_END>"), F.lit("")))


def made_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value made once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_marker(words: Column) -> Column:
    """1-based place of the last edit marker or <s>; 0 without one."""
    at = F.transform(words, lambda w, i: F.when(w.isin(*EDIT_TOKENS, "<s>"), i + 1).otherwise(0))
    return F.coalesce(F.array_max(at), F.lit(0))


def remove_edits(c: Column) -> Column:
    """What follows the last edit marker; empty without one."""
    return made_once(tokens(c), lambda words: made_once(_last_marker(words), lambda at: F.when(at == 0, F.lit("")).otherwise(_behind(words, at))))


def _behind(words: Column, at: Column) -> Column:
    return F.array_join(F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))), " ")


def strip_generation_edits(rows: DataFrame, column: str = "pred") -> DataFrame:
    """A table of generations without their plans; a row whose text has no marker stays, with an empty text."""
    return rows.withColumn(column, remove_edits(F.col(column)))


def separate_gen_edit(c: Column) -> tuple[Column, Column]:
    """(what follows the last edit marker, what goes up to it); without a marker all is the former."""
    parts = lambda part: made_once(tokens(c), lambda words: made_once(_last_marker(words), lambda at: part(words, at)))
    return parts(_behind), parts(lambda words, at: F.array_join(F.slice(words, 1, at), " "))


# Comment tags and marks that are taken out, in this order.
_TAGS = ("@return", "@ return", "@param", "@ param", "@throws", "@ throws")
_HTML_MARKS = ("{", "}", "@code", "@docRoot", "@inheritDoc", "@link", "@linkplain", "@value")
_COMMENT_MARKS = ("/**", "**/", "/*", "*/", "*")


def remove_tag_string(c: Column) -> Column:
    for tag in _TAGS:
        c = F.trim(F.replace(c, F.lit(tag), F.lit("")))
    return c


def remove_html_tag(c: Column) -> Column:
    c = F.regexp_replace(c, "<.*?>", "")
    for mark in _HTML_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def subtokenize_comment(c: Column, remove_tag: bool = True) -> Column:
    """Lower-case words, camel case split, every other sign a token of its own; joined by spaces."""
    if remove_tag:
        c = remove_tag_string(c)
    for mark in _COMMENT_MARKS:
        c = F.replace(c, F.lit(mark), F.lit(""))
    if remove_tag:
        c = remove_html_tag(F.trim(c))
    found = F.regexp_extract_all(c, F.lit(f"([a-zA-Z0-9]+|[^{BLANK}a-zA-Z0-9])"), 1)
    split = F.flatten(F.transform(found, lambda t: F.split(F.regexp_replace(t, "([a-z0-9])([A-Z])", "$1 $2"), " ")))
    return F.array_join(F.transform(split, F.lower), " ")


def pad_edit_markers(c: Column) -> Column:
    names = "|".join(re.escape(t) for t in sorted(EDIT_TOKENS, key=len, reverse=True))
    return normalize_ws(F.regexp_replace(c, f"({names})", " $1 "))


def empty_placeholder(c: Column) -> Column:
    return F.when(c == "", "<EMPTY>").otherwise(c)


def add_plan_separator(c: Column) -> Column:
    """"{edit} <s> {gen}" where <s> is missing; every row stays."""
    gen, edit = separate_gen_edit(c)
    return F.when(~F.contains(c, F.lit("<s>")), F.concat(edit, F.lit(" <s> "), gen)).otherwise(c)


def phrase_positions(words: Column, phrase: Column) -> Column:
    """0-based starts of the phrase in the words; none for an empty phrase."""
    last = F.size(words) - F.size(phrase)
    starts = F.when((last >= 0) & (F.size(phrase) > 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: F.slice(words, i + 1, F.size(phrase)) == phrase)


# Tokens that caption metrics leave out.
PUNCTUATION = ("''", "'", "``", "`", "-LRB-", "-RRB-", "-LCB-", "-RCB-", ".", "?", "!", ",", ":", "-", "--", "...", ";")


def drop_punctuation(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.isin(*PUNCTUATION))


def replace_unknown(c: Column) -> Column:
    """The unknown token of a scored text as the sign U+8D54."""
    return F.replace(c, F.lit("<unk>"), F.lit("\u8d54"))


def repair_utf8(c: Column) -> Column:
    """Bytes or text with the replacement character for what cannot be decoded."""
    return F.make_valid_utf8(c.cast("string"))


def dataset_text(dataset: Column, c: Column) -> Column:
    """Sub-tokens for comment datasets, the text itself for others."""
    return F.when(F.contains(dataset, F.lit("comment-update")), subtokenize_comment(c)).otherwise(c)


def marker_class(c: Column) -> Column:
    """struct of flags of an edit marker: kind (insert, keep, replace, delete), start, new, end; all false for other
    tokens. A marker can be of several kinds."""
    mark = c.isin(*EDIT_TOKENS)
    has = lambda part: F.coalesce(mark & F.contains(c, F.lit(part)), F.lit(False))
    kinds = [has(k).alias(k.lower()) for k in ("INSERT", "KEEP", "REPLACE", "DELETE")]
    start = F.coalesce(mark, F.lit(False)) & ~has("NEW") & ~has("END")
    return F.struct(*kinds, start.alias("start"), has("OLD").alias("old"), has("NEW").alias("new"), has("END").alias("end"))
