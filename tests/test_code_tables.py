"""Functions of source files, literals and comments."""

from pyspark.sql import functions as F

from palimpsest.functions import literals
from palimpsest.functions import text as T
from palimpsest.operators import code_tables


def _one(spark, column, value):
    return spark.createDataFrame([(value,)], "c string").select(column.alias("v")).first().v


def test_java_functions(spark):
    text = "class A { @ Override public int f ( ) { if ( x ) { y ; } } /* doc { */ static void g ( int a ) throws E { } // note ENDCOM int h ( ) { }  void open ( ) { a"
    df = spark.createDataFrame([(1, text), (2, "int first ( ) { }"), (3, ""), (4, None)], "id long, c string")
    got = {(r.id, r.idx): (r.function, r.standalone) for r in code_tables.java_function_table(df, "id", T.tokens(F.col("c"))).collect()}
    assert got == {
        (1, 0): ("public int f ( ) { if ( x ) { y ; } }", False), (1, 1): ("/* doc { */ static void g ( int a ) throws E { }", False),
        (1, 2): ("// note ENDCOM int h ( ) { }", False), (1, 3): ("void open ( ) { a", False), (2, 0): ("int first ( ) { }", False),
    }
    static = spark.createDataFrame([(1, "; public static int f ( ) { }")], "id long, c string")
    assert code_tables.java_function_table(static, "id", T.tokens(F.col("c"))).first().standalone is True


PYTHON = '''import os
def f(a):
    """Says what f does."""
    # a note here
    if a:
        return "x y"

class B:
    def g(self):
        pass
'''


def test_python_tokens_and_functions(spark):
    plain = _one(spark, code_tables.tokenize_python(F.col("c")), PYTHON)
    assert plain[:13] == "import os NEW_LINE def f ( a ) : NEW_LINE INDENT if a".split()
    assert '" x ▁ y "' in plain
    kept = _one(spark, code_tables.tokenize_python(F.col("c"), True), PYTHON)
    assert '""" Says ▁ what ▁ f ▁ does . """' in kept and "# ▁ a ▁ note ▁ here ENDCOM" in kept
    assert _one(spark, code_tables.tokenize_python(F.col("c")), "def (:\n  'open") == []
    assert _one(spark, code_tables.tokenize_python(F.col("c")), None) is None
    df = spark.createDataFrame([(1, PYTHON)], "id long, c string")
    got = [(r.standalone, r.function.split()[1]) for r in code_tables.python_function_table(df, "id", code_tables.tokenize_python(F.col("c"))).orderBy("idx").collect()]
    assert got == [(True, "f"), (False, "g")]
    whole = code_tables.python_function_table(df, "id", code_tables.tokenize_python(F.col("c"), True)).orderBy("idx").select(literals.python_doc_pair(F.col("function")).alias("p")).first().p
    assert "Says ▁ what" in whole.doc and "<INLINE> # ▁ a ▁ note" in whole.doc and "Says" not in whole.text and "note" not in whole.text


def test_literals(spark):
    c = F.col("c")
    assert _one(spark, literals.decode_unicode_escapes(c), r"aA\uu0042 \\u0041 😀 \n") == r"aAB \\u0041 " + "😀" + r" \n"
    assert _one(spark, literals.decode_unicode_escapes(c), "") == ""
    assert _one(spark, literals.escape_literal(c, "java"), '"a  b\\n"') == '" a ▁ ▁ b \\n "'
    assert _one(spark, literals.escape_literal(c, "java", True), "// xx ------- y\n") == "// ▁ xx ▁ - - - - - ▁ y ENDCOM"
    assert _one(spark, literals.escape_literal(c, "java", True), "// a") == ""
    assert _one(spark, literals.java_escaped_tokens(c), 'f("a b"); // c') == ["f", "(", '" a ▁ b "', ")", ";"]
    assert _one(spark, literals.java_escaped_tokens(c, True), "x; // note\n")[-1] == "// ▁ note ENDCOM"
    pair = _one(spark, literals.java_doc_pair(c), "/* says what */ int f ( ) { // see it ENDCOM }")
    assert (pair.text, pair.doc) == ("int f ( ) { }", "/* says what */ <INLINE> // see it ENDCOM")
    assert _one(spark, literals.java_doc_pair(c), "/* x */ int f ( ) { }").doc == ""
