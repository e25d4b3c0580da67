"""Registered queries of text columns, source code, further metrics and corruption, each beside its SQL twin.

The given tables hold no source code, so programs are written around the words of the conversations; what the operators
must find in them is known from how they were written, and that is what the twins state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import code, layout, literals
from palimpsest.functions import text as T
from palimpsest.operators import code_tables, corrupt, metrics, nesting, phrases, pipelines, structure
from palimpsest.plans import queries as Q
from palimpsest.sources import views as V


def q_text_columns(spark, d):
    c = F.col("text")
    marked = F.concat(F.lit("a<KEEP>b<INSERT_OLD>"), c)
    plan = F.concat(F.lit("<INSERT> x <INSERT_END> "), c)
    return V.table(spark, d, "documents").select(
        "doc_id", T.truncate_tokens(c, 5).alias("first"), F.size(T.drop_punctuation(T.tokens(F.concat(c, F.lit(" , ; -LRB- ... x"))))).alias("kept"),
        T.replace_unknown(F.concat(F.lit("<unk> "), c)).alias("known"), T.pad_edit_markers(marked).alias("padded"), T.add_plan_separator(plan).alias("separated"),
        T.add_plan_separator(F.lit("<s> a")).alias("already"), T.dataset_text(F.lit("x-comment-update"), c).alias("comment"), T.dataset_text(F.lit("code"), c).alias("code"),
        T.empty_placeholder(T.remove_edits(c)).alias("placeholder"), T.repair_utf8(c).alias("repaired"),
    )


_PUNCTUATION = """('''''', '''', '``', '`', '-LRB-', '-RRB-', '-LCB-', '-RCB-', '.', '?', '!', ',', ':', '-', '--', '...', ';')"""
_TEXT_COLUMNS = f"""with w as (select *, {V._TOK.format(V._ws('text'))} as w from documents)
select doc_id, array_to_string(w[:5], ' ') as first, len(list_filter(list_concat(w, [',', ';', '-LRB-', '...', 'x']), lambda x: x not in {_PUNCTUATION}))::int as kept, replace('<unk> ' || text, '<unk>', chr(36180)) as known,
  {V._ws("'a <KEEP> b <INSERT_OLD> ' || text")} as padded, '<INSERT> x <INSERT_END> <s> ' || array_to_string(w, ' ') as separated, '<s> a' as already, {Q._sql_subtokens('text')} as comment, text as code,
  case when len(w) = 0 or not list_has_any(w, (select list(m) from ({Q._MARKERS}))) then '<EMPTY>' end as placeholder, text as repaired from w"""


def q_split_model_input(spark, d):
    raw = Q.pairs(spark, d).select("example_id", F.concat(F.lit("\u00a0 "), "source", F.lit("\t </s>  "), "context", F.lit(" </s> "), "target", F.lit(" \u2028")).alias("x"))
    (source, rest), (_, stripped) = T.split_model_input(F.col("x")), T.split_model_input(F.col("x"), True)
    return raw.select("example_id", source.alias("source"), rest.alias("context"), stripped.alias("stripped"))


def q_strip_generations(spark, d):
    return T.strip_generation_edits(Q._marked(spark, d), "t").select("example_id", "t")


def q_pad_sequence(spark, d):
    from palimpsest.operators.ngrams import pad_sequence

    t = T.tokens(F.col("target"))
    both = lambda n, a, b: F.array_join(pad_sequence(t, n, a, b), " ")
    return Q.pairs(spark, d).select("example_id", both(3, "<s>", "</s>").alias("both"), both(2, "<s>", None).alias("left"), both(1, "<s>", "</s>").alias("none"))


def q_full_replace_plan(spark, d):
    from palimpsest.operators.edits import full_replace_plan

    plan = full_replace_plan(T.tokens(F.col("source")), T.tokens(F.col("target")))
    return Q.pairs(spark, d).select("example_id", F.array_join(plan, " ").alias("plan"))


# Words of a turn, which no language has as its own.
def _words(spark, d):
    words = F.regexp_extract_all(F.lower("source"), F.lit("([a-z]+)"), 1)
    return Q.pairs(spark, d).select("example_id", *[F.concat(F.lit("v"), F.coalesce(F.get(words, F.lit(k)), F.lit("x"))).alias(f"w{k + 1}") for k in range(4)])


_SQL_WORDS = V.SQL_PAIRS + ", l as (select example_id, regexp_extract_all(lower(source), '[a-z]+') as l from pairs), words as (select example_id, " + ", ".join(f"'v' || coalesce(l[{k}], 'x') as w{k}" for k in range(1, 5)) + " from l)"


def _filled(template: str):
    """A text with %1 to %4 for the words and %i for the id."""
    c = F.lit(template)
    for k in range(1, 5):
        c = F.replace(c, F.lit(f"%{k}"), F.col(f"w{k}"))
    return F.replace(c, F.lit("%i"), F.col("example_id").cast("string"))


def _sql_filled(template: str, comment: bool = False) -> str:
    """comment: the words as an escaped comment has them, runs of one character cut to five."""
    word = "array_to_string(list_filter(string_split(w{0}, ''), lambda x, i: i <= 5 or substr(w{0}, i - 5, 5) <> repeat(x, 5)), '')" if comment else "w{0}"
    c = "'" + template.replace("'", "''") + "'"
    for k in range(1, 5):
        c = f"replace({c}, '%{k}', {word.format(k)})"
    return f"replace({c}, '%i', example_id::varchar)"


_CLASS = "class A { @ Override public int f%i ( int %1 ) throws E { if ( %2 ) { return %3 ; } } int %4 ; /* %2 note */ static void g%i ( ) { } }"
_PYTHON = 'def f%i(%1, %2):\n    """Doc of %3."""\n    # note on %4\n    return %1 + %2\n\nclass B:\n    def g%i(self):\n        return \'%3 %4\'\n'


def q_java_function_table(spark, d):
    return code_tables.java_function_table(_words(spark, d).withColumn("c", _filled(_CLASS)), "example_id", T.tokens(F.col("c")))


def q_python_function_table(spark, d):
    rows = _words(spark, d).withColumn("c", _filled(_PYTHON))
    return code_tables.python_function_table(rows, "example_id", code_tables.tokenize_python(F.col("c")))


def q_tokenize_java(spark, d):
    """Tokens of a line with an escape, a literal and comments; escaped ones; and none for a line with an open literal."""
    line = _filled('int %1 = f(\\u0041, "%2 b"); // %3 x')
    join = lambda c: F.array_join(c, "|")
    return _words(spark, d).select(
        "example_id", join(code.tokenize_java(literals.decode_unicode_escapes(line))).alias("tokens"), join(literals.java_escaped_tokens(line)).alias("escaped"),
        join(literals.java_escaped_tokens(line, True)).alias("with_comments"), F.size(code.tokenize_java(_filled('int %1 = "%2'))).alias("malformed"),
        join(corrupt.tokenize_by_modality(_filled("%1=%2;"), "code")).alias("as_code"), join(corrupt.tokenize_by_modality(_filled("%1=%2;"), "nl")).alias("as_prose"),
    )


def q_tokenize_python(spark, d):
    join = lambda c: F.array_join(c, "|")
    rows = _words(spark, d).withColumn("c", _filled(_PYTHON))
    return rows.select("example_id", join(code_tables.tokenize_python(F.col("c"))).alias("tokens"), F.size(code_tables.tokenize_python(_filled("def (:\n  '%1"))).alias("malformed"))


def q_literals(spark, d):
    one = lambda s, comment=False, lang="java": literals.escape_literal(_filled(s), lang, comment)
    pair, python = literals.java_doc_pair(_filled("/* says %1 %2 */ int f ( ) { // see %3 ENDCOM }")), literals.python_doc_pair(_filled("def f ( ) : NEW_LINE INDENT ''' says %1 %2 ''' NEW_LINE return %3 NEW_LINE DEDENT"))
    return _words(spark, d).select(
        "example_id", one('"%1  %2"').alias("literal"), one("// %1 -------\n", True).alias("comment"), one("// x", True).alias("short"), one("'%1\t%2'", False, "python").alias("python"),
        pair["text"].alias("text"), pair["doc"].alias("doc"), python["text"].alias("python_text"), python["doc"].alias("python_doc"), literals.java_doc_pair(_filled("/* x */ int %1 ( )"))["doc"].alias("no_doc"),
    )


def q_code_columns(spark, d):
    args = code.java_arguments(T.tokens(_filled("void %1 ( final int [ ] %2 , %3 %4 ) { g ( %1 ) ; }")))
    none = code.java_arguments(T.tokens(_filled("void %1 ( ) { }")))
    join = lambda c: F.array_join(c, "|")
    role = lambda t, f: code.operator_role(F.lit(t))[f]
    return _words(spark, d).select(
        "example_id", code.java_function_name(T.tokens(_filled("static int %1 ( int %2 )"))).alias("java_name"), code.python_function_name(T.tokens(_filled("async def %2 ( %3 )"))).alias("python_name"),
        join(args["types"]).alias("types"), join(args["names"]).alias("names"), join(none["names"]).alias("no_names"),
        code.remove_java_annotation(_filled('@ Override @ SuppressWarnings ( "%1" ) void %2 ( )')).alias("bare"), code.is_python3(_filled("print ( %1 )")).alias("three"), code.is_python3(_filled("print %1")).alias("two"),
        F.concat_ws("", *[role(t, f).cast("int").cast("string") for t in ("+", "++", "+=", "(") for f in ("infix", "prefix", "postfix", "assignment")]).alias("roles"),
        code.remove_comments(_filled("x = '%1 # y' # %2\n\n\"\"\"%3\"\"\"\ny = 1\n"), "python").alias("python"), code.remove_comments(_filled("# %1"), "ruby").alias("ruby"),
    )


def q_layout(spark, d):
    rows = _words(spark, d).withColumn("c", _filled('class %1 { int %2 = f ( " a ▁ %3 " ) ; void g ( ) { h ( ) ; } ; int [ ] x = { 1 , 2 } ; }'))
    java = layout.detokenize_java(T.tokens(F.col("c")))
    python = layout.detokenize_python(_filled("def f ( ) : NEW_LINE INDENT if %1 : NEW_LINE INDENT x = ' a ▁ %2 ' NEW_LINE DEDENT DEDENT y . z NEW_LINE"))
    table = code.java_token_table(rows.select("example_id", _filled("class %1{int %2=f(%3,1);void g(){h();}}").alias("s")), "example_id", "s")
    return rows.select("example_id", java.alias("java"), python.alias("python")).join(layout.format_java_tokens(table, "example_id"), "example_id")


_CLASS_LIT = {k: v for k, v in {
    "java_function_table": """select example_id, 0 as idx, {a} as function, false as standalone from words union all select example_id, 1, {b}, true from words""".format(
        a=_sql_filled("int f%i ( int %1 ) throws E { if ( %2 ) { return %3 ; } }").replace("'int f", "'public int f", 1), b=_sql_filled("/* %2 note */ static void g%i ( ) { }")),
    "python_function_table": "select example_id, 0 as idx, {a} as function, true as standalone from words union all select example_id, 1, {b}, false from words".format(
        a=_sql_filled("def f%i ( %1 , %2 ) : NEW_LINE INDENT return %1 + %2 NEW_LINE DEDENT"), b=_sql_filled("def g%i ( self ) : NEW_LINE INDENT return ' %3 ▁ %4 ' NEW_LINE DEDENT")),
    "tokenize_java": "select example_id, {a} as tokens, {b} as escaped, {c} as with_comments, 0 as malformed, {d} as as_code, {e} as as_prose from words".format(
        a=_sql_filled('int|%1|=|f|(|A|,|"%2 b"|)|;'), b=_sql_filled('int|%1|=|f|(|A|,|" %2 ▁ b "|)|;'), c=_sql_filled('int|%1|=|f|(|A|,|" %2 ▁ b "|)|;') + " || " + _sql_filled("|// ▁ %3 ▁ x ENDCOM", True), d=_sql_filled("%1|=|%2|;"), e=_sql_filled("%1=%2;")),
    "tokenize_python": "select example_id, {a} as tokens, 0 as malformed from words".format(
        a=_sql_filled("def|f%i|(|%1|,|%2|)|:|NEW_LINE|INDENT|return|%1|+|%2|NEW_LINE|DEDENT|class|B|:|NEW_LINE|INDENT|def|g%i|(|self|)|:|NEW_LINE|INDENT|return|' %3 ▁ %4 '|NEW_LINE|DEDENT|DEDENT")),
    "literals": "select example_id, {a} as literal, {b} as comment, '' as short, {c} as python, {d} as text, {e} as doc, {f} as python_text, {g} as python_doc, '' as no_doc from words".format(
        a=_sql_filled('" %1 ▁ ▁ %2 "'), b=_sql_filled("// ▁ %1 ▁ - - - - - ENDCOM", True), c=_sql_filled("' %1 TABSYMBOL %2 '"), d="'int f ( ) { }'", e=_sql_filled("/* says %1 %2 */ <INLINE> // see %3 ENDCOM"),
        f=_sql_filled("def f ( ) : NEW_LINE INDENT NEW_LINE return %3 NEW_LINE DEDENT"), g=_sql_filled("''' says %1 %2 '''")),
    "code_columns": "select example_id, {a} as java_name, {b} as python_name, {c} as types, {d} as names, 'None' as no_names, {e} as bare, true as three, false as two, '1100011000010000' as roles, {f} as python, {g} as ruby from words".format(
        a=_sql_filled("%1"), b=_sql_filled("%2"), c=_sql_filled("final int [ ]|%3"), d=_sql_filled("%2|%4"), e=_sql_filled("void %2 ( )"), f=_sql_filled("x = '%1 # y' \ny = 1"), g=_sql_filled("# %1")),
    "layout": "select example_id, {a} as java, {b} as python, {c} as text from words".format(
        a=_sql_filled('class %1 {\n  int %2 = f ( "a %3" ) ;\n  void g ( ) {\n    h ( ) ;\n  };\n  int [ ] x = {\n    1 , 2 };\n  }\n  '), b=_sql_filled("def f ( ) :\n    if %1 :\n        x = 'a %2'\ny.z\n"),
        c=_sql_filled("class %1 {\n    int %2 = f(%3, 1);\n    void g() {\n        h();\n        \n    }\n}\n")),
}.items()}


def q_multi_bleu_corpus(spark, d):
    hyps, refs = V.eval_rows(spark, d).select("example_id", "pred"), V.refs_multi(Q.pairs(spark, d))
    return metrics.multi_bleu_corpora(hyps, refs)


def q_rescore(spark, d):
    """The rank-1 candidates against the references that the rank-0 ones were scored with, and both as one corpus."""
    p = Q.pairs(spark, d)
    refs, beams = V.refs_multi(p), V.candidates(p).select("example_id", "beam_rank", "pred")
    again = metrics.rescore(refs, beams.where("beam_rank = 1"))
    first = metrics.multi_ref_stats(beams.where("beam_rank = 0"), refs)
    return metrics.multi_bleu_corpus(again).select(F.lit("again").alias("of"), "*").unionByName(metrics.multi_bleu_corpus(metrics.append_stats(first, again)).select(F.lit("both").alias("of"), "*"))


def q_ngram_reference_frequency(spark, d):
    t = metrics.ngram_reference_frequency(V.refs_multi(Q.pairs(spark, d)))
    return t.groupBy("n").agg(F.count("*").alias("grams"), F.sum("examples").alias("total"), F.max("examples").alias("most"), F.round(F.max("share"), 6).alias("share"))


def q_caption_summary(spark, d):
    """The mean of every caption metric."""
    per = Q.q_caption_suite(spark, d)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in per.columns if c != "example_id"]))
    return per.select(named.alias("m")).groupBy("m.metric").agg(F.count("*").alias("examples"), F.round(F.avg("m.value"), 5).alias("mean"))


def q_noise_mask(spark, d):
    """Three noise spans of two tokens on average in every line of twelve tokens or more."""
    lines = V.clean_lines(spark, d).withColumn("t", T.tokens(F.col("text"))).select("id", F.size("t").alias("size")).where("size between 12 and 512")
    t = corrupt.noise_lengths(lines, 3.0, 2.0)
    mask = corrupt.noise_mask(F.col("plain_runs"), F.col("noise_runs"))
    spans = F.transform(corrupt.noise_spans(mask), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string")))
    return t.select("id", F.array_join(F.transform(mask, lambda x: x.cast("string")), "").alias("mask"), F.array_join(spans, ",").alias("spans"))


#: The same as [^A-Za-z ]+, which takes Java's engine several times as long.
_NO_LETTERS = r"[\x{0}-\x{1f}!-@\[-`{-\x{10ffff}]+"


def q_corrupt_java(spark, d):
    """Prose with a ; for everything that is no letter, as source code."""
    lines = V.clean_lines(spark, d).select("id", F.regexp_replace("text", _NO_LETTERS, " ; ").alias("text"))
    return Q._corrupted(pipelines.build_pretraining_pairs(lines, "code"))


_DRAW3 = lambda what: f"(('0x' || substr(md5('20:' || id || ':{what}'), 1, 8))::bigint / 4294967296.0::double)"


def _three(what: str, total: str) -> str:
    """Two cuts, the second among the places that the first has left."""
    return f"floor({_DRAW3(what)} * ({total} - 1))::int + 1 as {what}_a, floor({_DRAW3(what + ':2')} * ({total} - 2))::int + 1 as {what}_x"


_NOISE_MASK = f"""with l as (select doc_id as id, {V._TOK.format(V._ws('text'))} as t from documents union all select -1 - item_id, {V._TOK.format(V._ws('text'))} from benchmark),
s as (select id, len(t) as size, {_three('plain', '(len(t) - 6)')}, {_three('noise', '6')} from l where len(t) between 12 and 512),
c as (select *, case when plain_a <= plain_x then plain_x + 1 else plain_x end as plain_b, case when noise_a <= noise_x then noise_x + 1 else noise_x end as noise_b from s),
r as (select id, least(plain_a, plain_b) as p1, abs(plain_a - plain_b) as p2, size - 6 - greatest(plain_a, plain_b) as p3, least(noise_a, noise_b) as q1, abs(noise_a - noise_b) as q2, 6 - greatest(noise_a, noise_b) as q3 from c)
select id, repeat('0', p1::int) || repeat('1', q1::int) || repeat('0', p2::int) || repeat('1', q2::int) || repeat('0', p3::int) || repeat('1', q3::int) as mask,
  p1 || '-' || (p1 + q1) || ',' || (p1 + q1 + p2) || '-' || (p1 + q1 + p2 + q2) || ',' || (p1 + q1 + p2 + q2 + p3) || '-' || (p1 + p2 + p3 + 6) as spans from r"""

_EVAL_SUB = V.SQL_EVAL.replace(", evals as (", ", evals_raw as (") + f", evals as (select example_id, {Q._sql_subtokens('src')} as src, {Q._sql_subtokens('ref')} as ref, {Q._sql_subtokens('pred')} as pred, ctx, pred as raw_pred, ref as raw_ref from evals_raw)"
_EVAL_BEST = V.SQL_EVAL.replace("c.pred,", "c.pred as pred,").replace("join candidates c on p.example_id = c.example_id and c.beam_rank = 0", "join (select example_id, arg_max(pred, (base_score + second_score, -beam_rank)) as pred from candidates group by example_id) c on p.example_id = c.example_id")
_EVAL_LAST = V.SQL_EVAL.replace("c.beam_rank = 0", "c.beam_rank = 4")


def _summary(evals: str, code_bleu: str = "-1.0::double", meteor: str = "-1.0::double") -> str:
    return Q._SUMMARY.replace(V.SQL_EVAL, evals).replace("-1.0::double as code_bleu, -1.0::double as meteor", f"{code_bleu} as code_bleu, {meteor} as meteor")


def _sql_smoothed() -> str:
    stats = Q.SQL_STATS.replace("(values (1), (2), (3), (4)) k(n)", "(values (1), (2), (3), (4), (5)) k(n)")
    wide = ", ".join(f"max(case when n = {k} then num end) as x{k}, greatest(max(case when n = {k} then den end), 1) as d{k}" for k in range(1, 6))
    zeros = ["0"] + [" + ".join(f"(x{j} = 0)::int" for j in range(1, k)) for k in range(2, 5)]
    plain = [f"x{k} / d{k}" for k in range(1, 6)]
    m3 = [f"case when x{k} = 0 then 1 / (pow(2.0, {zeros[k - 1]} + 1) * d{k}) else {plain[k - 1]} end" for k in range(1, 5)]
    m4 = [f"case when x{k} = 0 and hlen > 1 then ({k} - 1 + 5 / ln(greatest(hlen, 2))) / d{k} when x{k} = 0 then 2.2250738585072014e-308 else {plain[k - 1]} end" for k in range(1, 5)]

    def averages(p: list[str]) -> list[str]:
        before, out = f"(({p[0]}) + 1)", []
        for a, b in zip(p, p[1:]):
            before = f"(({before} + ({a}) + ({b})) / 3)"
            out.append(before)
        return out

    w = [f"case when hlen >= 4 then 0.25 when {k} < hlen then 1.0 / greatest(hlen, 1) else 0 end" for k in range(4)]
    score = lambda p: f"round(100 * case when x1 = 0 then 0.0 else {Q._BP} * exp({' + '.join(f'({a}) * ln(nullif({b}, 0))' for a, b in zip(w, p))}) end, 6)"
    six = ["s1", "s2", "(x3 + 5 * case when s1 = 0 then 0.0 else s2 * s2 / s1 end) / (greatest(hlen - 2, 0) + 5)", "s4"]
    return f"""with {stats}, v as (select example_id, any_value(hlen) as hlen, any_value(rlen) as rlen, {wide} from per group by example_id),
t as (select *, x1 / d1 as s1, case when x2 > 0 then x2 / d2 end as s2 from v), u as (select *, {six[2]} as s3 from t),
z as (select *, (x4 + 5 * case when s2 = 0 then 0.0 else s3 * s3 / s2 end) / (greatest(hlen - 3, 0) + 5) as s4 from u)
select example_id, {score(m3)} as bleu_method3, {score(m4)} as bleu_method4, {score(averages(plain))} as bleu_method5, {score(['s1', 's2', 's3', 's4'])} as bleu_method6, {score(averages([*m4, plain[4]]))} as bleu_method7 from z"""


def _sql_rouge(base: str) -> str:
    """The longest common subsequence, a reference token at a time; a row's values rise, so they are a running maximum."""
    return f"""with recursive {base}, b as (select r.example_id, r.ref_idx, string_split(r.ref, ' ') as r, string_split(e.pred, ' ') as h from refs r join evals e using (example_id)),
lcs as (
  select example_id, ref_idx, 0 as j, list_transform(range(0, len(h) + 1), lambda x: 0) as v from b union all
  select example_id, ref_idx, j, list_transform(range(1, len(c) + 1), lambda i: list_max(c[:i])) from (
    select l.example_id, l.ref_idx, l.j + 1 as j, list_transform(range(1, len(l.v) + 1), lambda i: case when i = 1 then 0 when b.h[i - 1] = b.r[l.j + 1] then greatest(l.v[i], l.v[i - 1] + 1) else l.v[i] end) as c
    from lcs l join b using (example_id, ref_idx) where l.j < len(b.r))
), best as (select b.example_id, max(v[len(v)] / len(h)) as p, max(v[len(v)] / len(r)) as q from lcs join b using (example_id, ref_idx) where j = len(r) group by b.example_id)
select example_id, round(case when p = 0 or q = 0 then 0.0 else (1 + 1.44) * p * q / (q + 1.44 * p) end, 6) as rouge_l from best"""


_CLEAN = lambda c: f"array_to_string(list_filter({V._TOK.format(f'lower({c})')}, lambda x: x not in {_PUNCTUATION}), ' ')"
_REFS_CLEAN = V.SQL_REFS.replace(", evals as (", ", evals_raw as (").replace(", refs as (", f", evals as (select example_id, src, ref, {_CLEAN('pred')} as pred, ctx from evals_raw), refs_raw as (") + f", refs as (select example_id, ref_idx, {_CLEAN('ref')} as ref from refs_raw)"
_CAPTIONS = f"""select * exclude (length_ratio) from (with {Q._MULTI_BLEU.replace(V.SQL_REFS, _REFS_CLEAN)}) join (with {Q._CIDER.replace(V.SQL_REFS, _REFS_CLEAN)}) using (example_id) join ({_sql_rouge(_REFS_CLEAN)}) using (example_id)"""
_CORPUS = """select '{name}' as {key}, sum(hlen)::bigint as hlen, sum(rlen)::double as rlen, {bleus}, round((sum(hlen) + 1e-15::double) / (sum(rlen) + 1e-9::double), 6) as length_ratio from {table}"""


def _sql_corpus(key: str, name: str, table: str) -> str:
    """Corpus BLEU of a table example_id, hlen, rlen, num1 to num4."""
    p = [f"((sum(num{n}) + 1e-15::double) / (sum(greatest(hlen - {n} + 1, 0)) + 1e-9::double))" for n in range(1, 5)]
    ratio = "((sum(hlen) + 1e-15::double) / (sum(rlen) + 1e-9::double))"
    bp = f"case when {ratio} < 1 then exp(1 - 1 / {ratio}) else 1.0 end"
    bleus = ", ".join(f"round(pow({' * '.join(p[:n])}, 1 / {n}.0::double) * {bp}, 6) as bleu_{n}" for n in range(1, 5))
    return _CORPUS.format(key=key, name=name, table=table, bleus=bleus)


def _sql_matches(rank: int) -> str:
    """Matches of the rank's candidates, and the three reference lengths."""
    refs = V._TOK.format("ref")
    grams = "select {k}, n, array_to_string(t[i:i + n - 1], chr(1)) as gram, count(*) as c from (select *, unnest(range(1, len(t) - n + 2)) as i from {t}, (values (1), (2), (3), (4)) k(n)) group by all"
    return f"""h{rank} as (select example_id, {V._TOK.format('pred')} as t from candidates where beam_rank = {rank}), f{rank} as (select example_id, ref_idx, {refs} as t from refs),
hg{rank} as ({grams.format(k='example_id', t=f'h{rank}')}), rg{rank} as (select example_id, n, gram, max(c) as c from ({grams.format(k='example_id, ref_idx', t=f'f{rank}')}) group by all),
m{rank} as (select h.example_id, any_value(len(h.t)) as hlen, {', '.join(f'coalesce(any_value(k{n}), 0) as num{n}' for n in range(1, 5))} from h{rank} h left join (
  select example_id, {', '.join(f'sum(case when n = {n} then least(a.c, b.c) end) as k{n}' for n in range(1, 5))} from hg{rank} a join rg{rank} b using (example_id, n, gram) group by example_id) using (example_id) group by h.example_id),
l{rank} as (select example_id, min((abs(len(f.t) - hlen), len(f.t)))[2]::double as closest, min(len(f.t))::double as shortest, avg(len(f.t)) as average from m{rank} join f{rank} f using (example_id) group by example_id, hlen),
c{rank} as (select m.*, closest, shortest, average from m{rank} m join l{rank} using (example_id))"""


_CORPUS_BLEU = f"with {V.SQL_REFS}, {_sql_matches(0)} " + " union all ".join(_sql_corpus("ref_len", r, f"(select *, {r} as rlen from c0)") for r in ("closest", "shortest", "average"))
_RESCORE = f"with {V.SQL_REFS}, {_sql_matches(0)}, {_sql_matches(1)} " + " union all ".join(_sql_corpus("of", n, t) for n, t in (("again", "(select *, closest as rlen from c1)"), ("both", "(select *, closest as rlen from c0 union all select *, closest as rlen from c1)")))
_FREQUENCY = f"""with {V.SQL_REFS}, t as (select example_id, {V._TOK.format('ref')} as t from refs where ref_idx = 0),
g as (select n, gram, count(distinct example_id) as examples from (select example_id, n, array_to_string(t[i:i + n - 1], chr(1)) as gram from (select *, unnest(range(1, len(t) - n + 2)) as i from t, (values (1), (2), (3), (4)) k(n))) group by all)
select n::int as n, count(*) as grams, sum(examples)::bigint as total, max(examples) as most, round(max(examples) / 3.0::double, 6) as share from g group by n"""
_SPREAD = """round(avg(g), 6) as mean, round(sd, 6) as sd, round(avg(g) - 1.959964 * sd, 6) as low, round(avg(g) + 1.959964 * sd, 6) as high"""
_MULTIREF = Q._RESAMPLE[: Q._RESAMPLE.index("), pk as (")] + """), sg as (select example_id, ref_idx, round(exp(least(0.0, 1 - any_value(case when rlen = 0 then 1 else rlen end) / any_value(case when hlen = 0 then 1 else hlen end))
  + avg(ln(case when num = 0 then 1 else num end / case when den = 0 then 1 else den end))), 6) as g from st group by example_id, ref_idx),
sp as (select example_id, avg(g) as g, case when stddev_pop(g) < 1e-12 then 0.0 else stddev_pop(g) end as sd from sg group by example_id)
select example_id, round(g, 6) as mean, round(sd, 6) as sd, round(g - 1.959964 * sd, 6) as low, round(g + 1.959964 * sd, 6) as high from sp"""
_SIZES = f"len({V._TOK.format('source')})::int as {{}}, len({V._TOK.format('target')})::int as {{}}"
_CODE_BLEU = Q.QUERIES["code_bleu"][1]
_MARKER_SQL = f"""with {V.SQL_PAIRS}, k as (select *, row_number() over (order by m) - 1 as place from (values {Q._MARKER_TABLE}) x(m, a, b, c, d, e, f, g, h)),
r as (select k.* exclude (place) from pairs join k on (pairs.example_id % 24 + 24) % 24 = k.place union all select 'KEEPER', 0, 0, 0, 0, 0, 0, 0, 0 from pairs)
select m as marker, count(*) as n, max(a)::int as is_insert, max(b)::int as is_keep, max(c)::int as is_replace, max(d)::int as is_delete, max(e)::int as is_start, max(f)::int as is_old, max(g)::int as is_new, max(h)::int as is_end from r group by m"""


#: Elements that a tree of a page is made of; the fixed list keeps both engines' trees equal.
TAGS = "html|head|body|div|section|article|main|nav|header|footer|aside|ul|ol|li|table|form|h1|h2|p"
_TAG = f"<(/?)({TAGS})(?:\\s[^>]*)?>"


def q_span_nesting_depth(spark, d):
    """Brackets of whole pages: how deep they lie, how many never close, and how long their spans and their parents are."""
    text = F.coalesce("html", F.lit(""))
    t = V.table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(text, F.lit(r"[(){}\[\]]"), F.lit(0))).alias("pos", "sign"))
    opens, closes = F.col("sign").isin("(", "[", "{"), F.col("sign").isin(")", "]", "}")
    nested = nesting.span_nesting_depth(t, ["page_id"], opens, closes)
    spans = nesting.nested_parents(nesting.nested_spans(nested, ["page_id"], opens), ["page_id"])
    each = nested.groupBy("page_id").agg(F.count("*").alias("signs"), F.max("depth").alias("deepest"), F.min("depth").alias("lowest"), F.sum("depth").alias("depths"))
    sums = spans.groupBy("page_id").agg(F.sum(F.col("end") - F.col("pos")).alias("lengths"), F.sum(F.col("end").isNull().cast("long")).alias("open"), F.sum("parent").alias("parents"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return each.join(sums, "page_id", "left").select("page_id", "signs", "deepest", "lowest", "depths", zero("lengths"), zero("open"), zero("parents"))


def q_tag_trees(spark, d):
    """Every other page's element tree against the next page's: its subtrees, and those that the other holds anywhere."""
    pages = V.table(spark, d, "pages").select(F.expr("page_id div 2").alias("example_id"), F.when(F.col("page_id") % 2 == 0, "ref").otherwise("hyp").alias("side"), F.coalesce("html", F.lit("")).alias("html"))
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit(_TAG), F.lit(1)).alias("shut"), F.regexp_extract_all("html", F.lit(_TAG), F.lit(2)).alias("kind"))
    t = pages.select("example_id", "side", F.posexplode(found).alias("pos", "x")).select("example_id", "side", "pos", "x.*")
    key, opens = ["example_id", "side"], F.col("shut") == ""
    spans = nesting.nested_spans(nesting.span_nesting_depth(t, key, opens, ~opens), key, opens)
    nodes = nesting.nested_parents(spans, key).select(*key, F.col("pos").alias("node"), "parent", F.col("pos").alias("ordinal"), "kind")
    return structure.syntax_counts(structure.subtree_table(nodes))


def q_phrase_places(spark, d):
    """Runs of one to four tokens from every place of a target: how often and where first they stand in the source."""
    w = Q.pairs(spark, d).select("example_id", T.tokens(F.col("source")).alias("words"), T.tokens(F.col("target")).alias("t"))
    each = w.select("example_id", "t", F.posexplode("t").alias("phrase_id", "_")).withColumn("n", F.col("phrase_id") % 4 + 1).where("phrase_id + n <= size(t)")
    asked = each.select("example_id", "phrase_id", F.slice("t", F.col("phrase_id") + 1, F.col("n")).alias("phrase"))
    found = phrases.phrase_places(w, asked).groupBy("example_id", "phrase_id").agg(F.count("*").alias("places"), F.min("pos").alias("first"))
    return found.select("example_id", "phrase_id", (F.col("phrase_id") % 4 + 1).alias("tokens"), "places", "first")


def q_locate_longest(spark, d):
    """Where the first twelve tokens of a target, or the longest part of them, stand in the source."""
    w = Q.pairs(spark, d).select("example_id", T.tokens(F.col("source")).alias("w"), F.slice(T.tokens(F.col("target")), 1, 12).alias("x"))
    return w.select("example_id", phrases.locate_longest(F.col("w"), F.col("x")).alias("f")).where("f is not null").select("example_id", "f.*")


#: Twins of queries that queries.py defines.
TWINS = {
    "edit_opcodes": f"with {V.SQL_PAIRS} select example_id, source as old_side, target as new_side, true as well_formed from pairs",
    "code_edit_plan": f"with {V.SQL_PAIRS} select example_id, source as old_side, target as new_side, {_SIZES.format('old_commands', 'new_commands')} from pairs",
    "minimal_edit_plan": f"with {V.SQL_PAIRS} select example_id, target as text, true as unique_phrases from pairs",
    "comment_edit_plan": f"with {V.SQL_PAIRS} select example_id, target as text, true as unique_phrases from pairs",
    "replay_code_plan": f"with {V.SQL_PAIRS} select example_id, target as text from pairs",
    "edit_token_labels": f"with {V.SQL_PAIRS} select example_id, source as old_side, target as new_side from pairs",
    "reconstruct_predictions": f"with {V.SQL_CANDIDATES} select beam_rank, count(*) as examples, count(*) as restored, sum((case when pred = '' then '<EMPTY>' else pred end = target)::int)::bigint as hits from candidates join pairs using (example_id) group by beam_rank",
    "build_edit_dataset": f"with {V.SQL_PAIRS} select example_id, source || ' </s> ' || context as model_input, target, target as behind_plan, len({V._TOK.format('target')})::int as new_size, false as keeps from pairs",
    "prepare_rerank": f"with {V.SQL_EVAL} select c.example_id, c.beam_rank, src || ' </s> ' || ctx as full_src, c.pred as scored, base_score, len({V._TOK.format('c.pred')})::int as new_size from candidates c join evals using (example_id)",
    "rerank_scored": f"""with {V.SQL_EVAL}, s as (select c.*, -abs(length(src || ' </s> ' || ctx) - length(c.pred)) / (length(src || ' </s> ' || ctx) + 1.0::double) as own from candidates c join evals using (example_id))
select example_id, arg_max(beam_rank, (base_score + own, -beam_rank)) as rerank_rank, arg_max(pred, (base_score, -beam_rank)) as top1, arg_max(pred, (base_score + own, -beam_rank)) as rerank_pred,
  replace(arg_max(pred, (base_score + own, -beam_rank)), '<unk>', chr(36180)) as scored_text, 0::bigint as unmatched from s group by example_id""",
    "caption_suite": _CAPTIONS,
    "marker_classes": _MARKER_SQL,
    "smoothed_bleu": _sql_smoothed(),
    "gleu_multiref": f"with {_MULTIREF}",
    "rouge_l": _sql_rouge(V.SQL_REFS),
    "evaluation_summary": _summary(V.SQL_EVAL, "round(avg(code_bleu), 6)").replace("join s using (example_id)", f"join s using (example_id) join ({_CODE_BLEU}) cb using (example_id)"),
    "merge_shards": f"with {V.SQL_CANDIDATES} select example_id as id, arg_max(pred, beam_rank) as data from candidates group by example_id",
}

QUERIES = {
    "text_columns": (q_text_columns, _TEXT_COLUMNS),
    "split_model_input": (q_split_model_input, f"with {V.SQL_PAIRS} select example_id, rtrim(source) as source, '  ' || context || ' </s> ' || target as context, ltrim(context || ' </s> ' || target) as stripped from pairs"),
    "strip_generations": (q_strip_generations, f"with {V.SQL_PAIRS} select example_id, target as t from pairs"),
    "pad_sequence": (q_pad_sequence, f"with {V.SQL_PAIRS} select example_id, '<s> <s> ' || target || ' </s> </s>' as both, '<s> ' || target as left, target as none from pairs"),
    "full_replace_plan": (q_full_replace_plan, f"with {V.SQL_PAIRS} select example_id, array_to_string(list_concat(list_concat(list_concat(list_concat(['<REPLACE_OLD>'], {V._TOK.format('source')}), ['<REPLACE_NEW>']), {V._TOK.format('target')}), ['<REPLACE_END>']), ' ') as plan from pairs"),
    "coarse_diff": (Q.q_coarse_diff, f"with {V.SQL_PAIRS} select example_id, (len({V._TOK.format('source')}) + len({V._TOK.format('target')}))::bigint as tokens, true as known_kinds from pairs"),
    "span_nesting_depth": (q_span_nesting_depth, """with t as (
  select page_id, generate_subscripts(s, 1) - 1 as pos, unnest(s) as sign from (select page_id, regexp_extract_all(html, '[(){}\\[\\]]') as s from pages)
), b as (select *, sign in ('(', '[', '{') as opens, sum(case when sign in ('(', '[', '{') then 1 else -1 end) over (partition by page_id order by pos) as depth from t
), o as (
  select b.page_id, b.pos, (select min(c.pos) from b c where c.page_id = b.page_id and c.pos > b.pos and c.depth < b.depth) as shut,
    (select max(c.pos) from b c where c.page_id = b.page_id and c.pos < b.pos and c.opens and c.depth = b.depth - 1) as parent
  from b where opens
), sums as (select page_id, sum(shut - pos) as lengths, count(*) filter (shut is null) as open, sum(parent) as parents from o group by page_id)
select page_id, count(*) as signs, max(depth)::bigint as deepest, min(depth)::bigint as lowest, sum(depth)::bigint as depths,
  coalesce(any_value(lengths), 0)::bigint as lengths, coalesce(any_value(open), 0)::bigint as open, coalesce(any_value(parents), 0)::bigint as parents
from b left join sums using (page_id) group by page_id"""),
    "tag_trees": (q_tag_trees, f"""with recursive t as (
  select example_id, side, generate_subscripts(k, 1) - 1 as pos, unnest(k) as kind, unnest(c) as shut from (
    select page_id // 2 as example_id, case when page_id % 2 = 0 then 'ref' else 'hyp' end as side,
      regexp_extract_all(html, '{_TAG}', 2) as k, regexp_extract_all(html, '{_TAG}', 1) as c from pages)
), b as (select *, sum(case when shut = '' then 1 else -1 end) over (partition by example_id, side order by pos) as depth from t
), nodes as (
  select example_id, side, pos as node, kind, depth, (select max(c.pos) from b c where c.example_id = b.example_id and c.side = b.side and c.pos < b.pos and c.shut = '' and c.depth = b.depth - 1) as parent
  from b where shut = ''
), levels as (
  select example_id, side, node, parent, 0 as up, node as top, kind from nodes
  union all
  select l.example_id, l.side, l.node, p.parent, l.up + 1, p.node, l.kind from levels l join nodes p on l.example_id = p.example_id and l.side = p.side and l.parent = p.node
), texts as (
  -- The preorder of kinds, each with its depth below the top, tells a tree from every other.
  select example_id, side, top, string_agg(kind || ':' || up, ' ' order by node) as sexp from levels group by example_id, side, top
), held as (
  select x.example_id, x.side, x.sexp from texts x join nodes n on n.example_id = x.example_id and n.side = x.side and n.node = x.top
  where n.parent is null or exists (select 1 from nodes c where c.example_id = n.example_id and c.side = n.side and c.parent = n.node)
), counted as (select example_id, sexp, count(*) filter (side = 'ref') as r, count(*) filter (side = 'hyp') as h from held group by example_id, sexp)
select example_id, sum(case when h > 0 then r else 0 end)::bigint as s_match, sum(r)::bigint as s_all from counted group by example_id"""),
    "phrase_places": (q_phrase_places, f"""with {V.SQL_PAIRS}, w as (select example_id, {V._TOK.format('source')} as w, {V._TOK.format('target')} as t from pairs),
x as (select example_id, w, p, t[p + 1:p + 1 + p % 4] as phrase from (select *, unnest(range(0, len(t))) as p from w) where p + 1 + p % 4 <= len(t)),
f as (select example_id, p, len(phrase) as n, list_filter(range(0, len(w) - len(phrase) + 1), lambda i: w[i + 1:i + len(phrase)] = phrase) as places from x)
select example_id, p::int as phrase_id, n::int as tokens, len(places)::bigint as places, list_min(places)::int as first from f where len(places) > 0"""),
    "locate_longest": (q_locate_longest, f"""with {V.SQL_PAIRS}, w as (select example_id, {V._TOK.format('source')} as w, {V._TOK.format('target')}[1:12] as x from pairs),
parts as (select example_id, w, i, j, x[i + 1:j] as part from (select *, unnest(range(i + 1, len(x) + 1)) as j from (select *, unnest(range(0, len(x))) as i from w))),
f as (select *, list_filter(range(0, len(w) - len(part) + 1), lambda k: w[k + 1:k + len(part)] = part) as places from parts),
best as (select *, row_number() over (partition by example_id order by i, j desc) as nth from f where len(places) > 0)
select example_id, list_min(places)::int as place, i::int as skipped, len(part)::int as length, len(places) > 1 as ambiguous from best where nth = 1"""),
    "near_copy_minimal_plan": (Q._minimal("other", V.edit_pairs), f"with {V.SQL_EDIT_PAIRS} select example_id, target as text, true as unique_phrases from edits"),
    "near_copy_comment_plan": (Q._minimal("comment", V.edit_pairs), f"with {V.SQL_EDIT_PAIRS} select example_id, target as text, true as unique_phrases from edits"),
    "prepare_rerank_comment": (Q.q_prepare_rerank_comment, f"""with {V.SQL_EVAL} select c.example_id, c.beam_rank, {Q._strip_tags(V._ws("'@return ' || src"))} || ' </s> ' || ctx as full_src,
  {Q._strip_tags(V._ws("' @param' || c.pred"))} as seq_to_score, {Q._strip_tags(V._ws("'@return ' || ref"))} as ref from candidates c join evals using (example_id)"""),
    "evaluation_summary_comment": (Q.q_evaluation_summary_comment, _summary(_EVAL_SUB, meteor="round(avg(length(raw_pred) / greatest(length(raw_ref), 1)) * 100, 6)")),
    "evaluate_after_rerank": (Q.q_evaluate_after_rerank, _summary(_EVAL_BEST)),
    "merge_and_evaluate": (Q.q_merge_and_evaluate, _summary(_EVAL_LAST)),
    "inspect_rerank": (Q.q_inspect_rerank, f"""with {V.SQL_CANDIDATES}, b as (select example_id, arg_max(pred, (base_score + second_score, -beam_rank)) as best, arg_min(pred, beam_rank) as base from candidates group by example_id)
select example_id, target as ref, base as base_pred, best as rerank_pred, base <> best as changed, ((best = target)::int - (base = target)::int) as helped from b join pairs using (example_id)"""),
    "keep_beams": (Q.q_keep_beams, f"with {V.SQL_CANDIDATES} select example_id, count(*) as n, max(beam_rank) as last, arg_min(pred, beam_rank) as first from candidates where beam_rank < 3 group by example_id"),
    "multi_bleu_corpus": (q_multi_bleu_corpus, _CORPUS_BLEU),
    "rescore": (q_rescore, _RESCORE),
    "ngram_reference_frequency": (q_ngram_reference_frequency, _FREQUENCY),
    "caption_summary": (q_caption_summary, f"select metric, count(*) as examples, round(avg(value), 5) as mean from (unpivot ({_CAPTIONS}) on columns(* exclude (example_id)) into name metric value value) group by metric"),
    "noise_mask": (q_noise_mask, _NOISE_MASK),
    "corrupt_java": (q_corrupt_java, Q._sql_corrupt("code").replace(V._ws("text"), f"regexp_replace({V._ws('text')}, '[^A-Za-z ]+', ' ; ', 'g')")),
    **{name: (globals()[f"q_{name}"], f"with {_SQL_WORDS} {sql}") for name, sql in _CLASS_LIT.items()},
}
