"""Column functions over source code; all native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import made_once

# The language's words.
JAVA_KEYWORDS = tuple(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while".split()
)
CSHARP_KEYWORDS = tuple(
    "abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else enum event explicit extern false "
    "finally fixed float for foreach goto if implicit in int interface internal is lock long namespace new null object operator out override params private "
    "protected public readonly ref return sbyte sealed short sizeof stackalloc static string struct switch this throw true try typeof uint ulong unchecked "
    "unsafe ushort using virtual void volatile while add alias ascending async await by descending dynamic equals from get global group into join let nameof "
    "notnull on orderby partial remove select set unmanaged value var when where yield".split()
)
BASIC_TYPES = ("boolean", "byte", "char", "double", "float", "int", "long", "short")
MODIFIERS = ("abstract", "default", "final", "native", "private", "protected", "public", "static", "strictfp", "synchronized", "transient", "volatile")
PREFIX, POSTFIX = ("++", "--", "!", "~", "+", "-"), ("++", "--")
INFIX = ("||", "&&", "|", "^", "&", "==", "!=", "<", ">", "<=", ">=", "<<", ">>", ">>>", "+", "-", "*", "/", "%")
ASSIGNMENT = ("=", "+=", "-=", "*=", "/=", "&=", "|=", "^=", "%=", "<<=", ">>=", ">>>=")

#: Ordered alternatives; the same text in Spark's and in the SQL twin's regular expressions. >> stays two tokens.
_LINE, _BLOCK = r"//[^\n]*", r"/\*(?s:.*?)\*/"
_STRING, _CHAR = r'"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"', r"'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'"
_NUMBER = r"0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDlL]?"
_WORD = r"[\p{L}_$][\p{L}\p{Nd}_$]*"
_OPERATOR = r">>>=|>>=|<<=|\+\+|--|->|::|==|!=|<=|>=|&&|\|\||<<|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/%&|^<>=!~?:]"
JAVA_TOKEN = "|".join([_LINE, _BLOCK, _STRING, _CHAR, _NUMBER, _WORD, r"\.\.\.", r"[(){}\[\];,.@]", _OPERATOR, r"[^ \t\n\r\f]"])

#: Kind of a token by the first rule it meets: (kind, regular expression or list of words).
JAVA_KINDS = [
    ("comment", r"^/[/*]"), ("string", r"""^("[^\n]*"|'[^\n]*')$"""), ("number", r"^\.?[0-9]"), ("boolean", ("true", "false")), ("null", ("null",)),
    ("basic_type", BASIC_TYPES), ("modifier", MODIFIERS), ("keyword", JAVA_KEYWORDS), ("identifier", rf"^{_WORD}$"), ("annotation", ("@",)),
    ("separator", ("(", ")", "{", "}", "[", "]", ";", ",", ".", "...")), ("operator", rf"^({_OPERATOR})$"),
]

#: A stray token on a line of its own: a single character that no other kind has.
JAVA_STRAY = r"(?md)^[^0-9\p{L}_$(){}\[\];,.@\-+*/%&|^<>=!~?:\n]$"


def java_tokens(c: Column, keep_comments: bool = False) -> Column:
    """Tokens of a source text in order, comments only on request; stray characters stand alone, null gives null."""
    found = F.regexp_extract_all(c, F.lit(f"({JAVA_TOKEN})"), 1)
    return found if keep_comments else F.filter(found, lambda t: ~(t.startswith("//") | t.startswith("/*")))


def java_kind(token: Column) -> Column:
    """comment, string (also of characters), number, ..., operator; "stray" for a character outside the language, such
    as the quote that opens an unterminated literal."""
    rules = [token.rlike(rule) if isinstance(rule, str) else token.isin(*rule) for _, rule in JAVA_KINDS]
    chain = F.when(rules[0], JAVA_KINDS[0][0])
    for (kind, _), rule in zip(JAVA_KINDS[1:], rules[1:], strict=True):
        chain = chain.when(rule, kind)
    return chain.otherwise("stray")


def java_token_table(rows: DataFrame, key: str, text: str, keep_comments: bool = False) -> DataFrame:
    """(key, pos, token, kind), a row for each token; a text without one has no row."""
    return rows.select(key, F.posexplode(java_tokens(F.col(text), keep_comments)).alias("pos", "token")).withColumn("kind", java_kind(F.col("token")))


def tokenize_java(c: Column, most: int | None = None) -> Column:
    """Tokens without comments; none at all if the text is malformed (a stray character, an open literal or comment), or
    has more than ``most`` tokens."""
    none = F.array().cast("array<string>")
    # The tokens as lines of one text, which one pattern goes through: no token but a comment crosses lines.
    malformed = lambda found: F.array_join(found, "\n").rlike(JAVA_STRAY)
    if most is None:
        return made_once(java_tokens(c), lambda found: F.when(malformed(found), none).otherwise(found))
    # Blanks stand in literals and comments only, so that without them a text has a token for each of its pieces at
    # least: one of many pieces is not taken apart.
    holds_blanks = reduce(lambda a, b: a | b, [F.contains(c, F.lit(sign)) for sign in ('"', "'", "//", "/*")])
    many = ~holds_blanks & (F.size(F.split(c, r"[ \t\n\r\f]+", most + 3)) > most + 2)  # empty pieces at both ends, if any
    return F.when(many, none).otherwise(made_once(java_tokens(c), lambda found: F.when((F.size(found) > most) | malformed(found), none).otherwise(found)))


def operator_role(token: Column) -> Column:
    """struct of flags: infix, prefix, postfix, assignment."""
    return F.struct(token.isin(*INFIX).alias("infix"), token.isin(*PREFIX).alias("prefix"), token.isin(*POSTFIX).alias("postfix"), token.isin(*ASSIGNMENT).alias("assignment"))


#: Pieces of a C-like text: comments, literals (which may cross lines), and what lies between.
C_PIECES = r"""//[^\n]*|/\*(?s:.*?)\*/|'[^\\']*(?:\\(?s:.)[^\\']*)*'|"[^\\"]*(?:\\(?s:.)[^\\"]*)*"|[^/'"]+|[/'"]"""


#: The same of a Python text.
PYTHON_PIECES = r"""#[^\n]*|'{3}(?s:.*?)'{3}|"{3}(?s:.*?)"{3}|'[^\\'\n]*(?:\\[^\n][^\\'\n]*)*'|"[^\\"\n]*(?:\\[^\n][^\\"\n]*)*"|[^#'"]+|['"]"""


def remove_comments(c: Column, language: str = "java") -> Column:
    """A text without comments and blank lines; literals stay whole. In a C-like one a space stands for each comment; in
    "python" strings that stand alone at a line's start go too; "ruby" stays as it is."""
    if language == "ruby":
        return c
    found = F.regexp_extract_all(c, F.lit(f"({PYTHON_PIECES if language == 'python' else C_PIECES})"), 1)
    if language == "python":
        before = lambda i: F.when(i > 0, F.get(found, F.greatest(i - 1, F.lit(0)))).otherwise("\n")
        gone = lambda p, i: p.startswith("#") | (p.rlike("""^["']""") & before(i).rlike(r"\n[ \t]*$"))
        pieces = F.transform(found, lambda p, i: F.when(gone(p, i), "").otherwise(p))
    else:
        pieces = F.transform(found, lambda p: F.when(p.rlike("^/[/*]"), " ").otherwise(p))
    return F.array_join(F.filter(F.split(F.array_join(pieces, ""), "\n"), lambda line: line.rlike(r"[^ \t\r\f]")), "\n")


def remove_java_annotation(c: Column) -> Column:
    """Without leading @ Override, @ Deprecated and @ SuppressWarnings, its bracket included."""
    return F.regexp_replace(c, r"^(?:@ (?:Override|Deprecated|SuppressWarnings)(?: ?\( ?[^)]*\))? ?)+", "")


def java_function_name(words: Column) -> Column:
    """The token before the first bracket; null without one."""
    at = F.array_position(words, "(")
    return F.when(at > 1, F.get(words, (at - 2).cast("int")))


def python_function_name(words: Column) -> Column:
    """The token behind the first def; null without one."""
    at = F.array_position(words, "def")
    return F.when(at > 0, F.get(words, at.cast("int")))


# Signs of version 2 of the language, as patterns and as plain pieces.
_PYTHON2 = ("print [^(]", r"raise \w+ ,", r"except \w+ ,", r"[^ ]+ = \d+ L")
_PYTHON2_PIECES = (". iterkeys ( )", ". itervalues ( )", ". iteritems ( )", "xrange (", "imap (")


def is_python3(c: Column) -> Column:
    """False for functions with a sign of version 2."""
    signs = [c.rlike(p) for p in _PYTHON2] + [F.contains(c, F.lit(p)) for p in _PYTHON2_PIECES]
    return ~reduce(lambda a, b: a | b, signs)


def java_arguments(words: Column) -> Column:
    """struct of types and names, arrays of the same length, of the first bracketed list; "None" for an empty list or
    none at all. Array brackets go to the type; commas inside generics part arguments like any other."""
    rest = F.slice(words, F.greatest(F.array_position(words, "("), F.lit(1)).cast("int"), F.greatest(F.size(words), F.lit(1)))
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("own"), F.lit(False).alias("done"))

    def step(s: Column, w: Column) -> Column:
        depth = s["depth"] + F.when(w == "(", 1).when(w == ")", -1).otherwise(0)
        grown = F.struct(depth.alias("depth"), F.concat(s["own"], F.array(w)).alias("own"), (depth == 0).alias("done"))
        return F.when(s["done"], s).otherwise(grown)

    own = F.aggregate(rest, start, step, lambda s: s["own"])
    inside = F.array_join(F.slice(own, 2, F.greatest(F.size(own) - 2, F.lit(0))), " ")
    parts = F.transform(F.split(inside, ","), lambda a: F.struct(
        F.trim(F.regexp_replace(F.replace(a, F.lit("[ ]"), F.lit("")), " +", " ")).alias("a"), F.array_join(F.regexp_extract_all(a, F.lit(r"(\[ \])"), 1), " ").alias("b")
    ))
    name = lambda p: F.element_at(F.split(p["a"], " "), -1)
    kind = lambda p: F.trim(F.concat_ws(" ", F.regexp_replace(p["a"], " ?[^ ]*$", ""), p["b"]))
    none = F.array(F.lit("None"))
    empty = (F.array_position(words, "(") == 0) | (inside == "")
    return F.struct(F.when(empty, none).otherwise(F.transform(parts, kind)).alias("types"), F.when(empty, none).otherwise(F.transform(parts, name)).alias("names"))
