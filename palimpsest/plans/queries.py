"""Registered queries of the edit and evaluation operators, each beside its SQL twin."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import code
from palimpsest.functions import text as T
from palimpsest.operators import corrupt, edits, metrics, ngrams, phrases, pipelines, plans, rerank, structure
from palimpsest.sources import views as V
from palimpsest.sources.shared import cut

_GRAMS = """
sides as (select example_id, 'src' as side, {src} as t from evals union all
  select example_id, 'ref', {ref} from evals union all select example_id, 'hyp', {hyp} from evals),
grams as (
  select example_id, n, gram, count(*) filter (side = 'src') as c_src, count(*) filter (side = 'ref') as c_ref, count(*) filter (side = 'hyp') as c_hyp
  from (select example_id, side, n, array_to_string(t[i:i + n - 1], chr(1)) as gram
        from (select *, unnest(range(1, len(t) - n + 2)) as i from sides, (values (1), (2), (3), (4)) k(n)))
  group by example_id, n, gram)"""
_TOKENS = {k: V._TOK.format(c) for k, c in (("src", "src"), ("ref", "ref"), ("hyp", "pred"))}
SQL_GRAMS = V.SQL_EVAL + "," + _GRAMS.format(**_TOKENS)
SQL_STATS = SQL_GRAMS + f""", lengths as (
  select example_id, len({_TOKENS['hyp']})::double as hlen, len({_TOKENS['ref']})::double as rlen from evals
), per as (
  select l.example_id, hlen, rlen, k.n, coalesce(num, 0)::double as num, coalesce(pen, 0)::double as pen, greatest(hlen + 1 - k.n, 0) as den
  from lengths l cross join (values (1), (2), (3), (4)) k(n)
  left join (select example_id, n, sum(least(c_hyp, c_ref)) as num, sum(case when c_ref = 0 then least(c_hyp, c_src) else 0 end) as pen
             from grams group by example_id, n) g on g.example_id = l.example_id and g.n = k.n
)"""
_BP = "case when hlen > rlen then 1.0 when hlen = 0 then 0.0 else exp(1 - rlen / greatest(hlen, 1)) end"


def pairs(spark, d):
    return V.turn_pairs(spark, d)


def q_normalize_ws(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.normalize_ws(F.col("text")).alias("text"))


def q_subtokenize_comment(spark, d):
    return V.table(spark, d, "documents").select("doc_id", T.subtokenize_comment(F.col("text")).alias("text"))


def q_split_render_input(spark, d):
    raw = pairs(spark, d).select("example_id", F.concat("source", F.lit("<s>"), "context", F.lit("<s>"), "target").alias("raw"))
    source, context = T.split_raw_input(F.col("raw"))
    return raw.select("example_id", T.render_model_input(source, context).alias("model_input"))


def _marked(spark, d):
    return pairs(spark, d).select("example_id", F.concat(F.lit("<KEEP> "), "context", F.lit(" <KEEP_END> <INSERT> "), "source", F.lit(" <INSERT_END> <s> "), "target").alias("t"))


_SQL_MARKED = V.SQL_PAIRS + ", marked as (select example_id, '<KEEP> ' || context || ' <KEEP_END> <INSERT> ' || source || ' <INSERT_END> <s> ' || target as t, target, source from pairs)"


def q_remove_keep_span(spark, d):
    return _marked(spark, d).select("example_id", T.remove_keep_span(F.col("t")).alias("text"))


def q_remove_edits(spark, d):
    tail, head = T.separate_gen_edit(F.col("t"))
    return _marked(spark, d).select("example_id", T.remove_edits(F.col("t")).alias("text"), tail.alias("gen"), F.length(head).cast("long").alias("edit_chars"))


def q_exact_match(spark, d):
    hits = V.candidates(pairs(spark, d)).join(pairs(spark, d).select("example_id", "target"), "example_id")
    return hits.groupBy("beam_rank").agg(F.round(F.avg((F.col("pred") == F.col("target")).cast("int")) * 100, 6).alias("exact_match"))


def q_copy_pct(spark, d):
    sub = lambda c: T.subtokenize_comment(F.col(c))
    rows = V.eval_rows(spark, d)
    return rows.agg(F.count("*").alias("examples"), F.round(F.avg((sub("src") == sub("pred")).cast("int")) * 100, 6).alias("copy_pct"), F.round(F.avg((F.col("ctx") == F.col("pred")).cast("int")) * 100, 6).alias("context_pct"))


def q_ngram_counts(spark, d):
    rows = V.table(spark, d, "documents").select("doc_id", "text")
    return ngrams.gram_counts(rows, "doc_id", T.tokens(F.col("text")))


def q_sentence_bleu(spark, d):
    return metrics.sentence_bleu(metrics.overlap_stats(V.eval_rows(spark, d)), ("method0", "method1", "method2", "method2_higher_orders"))


def _sql_bleu(method: str) -> str:
    p = {"method0": "case when num = 0 then 2.2250738585072014e-308 else num / gd end", "method1": "case when num = 0 then 0.1 / gd else num / gd end",
         "method2": "(num + 1) / (gd + 1)", "method2_higher_orders": "case when n > 1 then (num + 1) / (gd + 1) when num = 0 then 1 else num / gd end"}[method]
    w = "case when hlen >= 4 then 0.25 when n - 1 < hlen then 1.0 / greatest(hlen, 1) else 0 end"
    return f"round(100 * case when max(case when n = 1 then num end) = 0 then 0.0 else any_value({_BP}) * exp(sum(({w}) * ln({p}))) end, 6) as bleu_{method}"


def q_corpus_bleu(spark, d):
    return metrics.corpus_bleu(metrics.overlap_stats(V.eval_rows(spark, d)))


def q_gleu(spark, d):
    rows = V.eval_rows(spark, d)
    gleu = metrics.sentence_gleu(metrics.overlap_stats(rows))
    return gleu.join(rows.select("example_id", (F.col("ref") == F.col("pred")).cast("int").alias("exact")), "example_id")


_SQL_GLEU = "exp(least(0.0, 1 - {one_r} / {one_h}) + avg(ln({one_num} / {one_den})))"


def q_gleu_corpus(spark, d):
    return metrics.corpus_gleu(metrics.overlap_stats(V.eval_rows(spark, d)))


def q_sari(spark, d):
    return metrics.sari(V.eval_rows(spark, d).select("example_id", "src", "pred", F.array("ref").alias("refs")))


def q_cider(spark, d):
    p = pairs(spark, d)
    return metrics.cider(V.eval_rows(spark, d).select("example_id", "pred"), V.refs_multi(p))


def _split(spark, d):
    c = V.candidates(pairs(spark, d))
    return c.drop("second_score"), c.select("example_id", "beam_rank", "second_score")


def q_rerank_best(spark, d):
    return rerank.rerank_best(*_split(spark, d))


def q_rerank_hits(spark, d):
    beams, scores = _split(spark, d)
    refs = pairs(spark, d).select("example_id", F.col("target").alias("ref"))
    return rerank.rerank_hits(beams, rerank.rerank_best(beams, scores), refs)


def q_collect_beams(spark, d):
    return rerank.collect_beams(_split(spark, d)[0])


def q_merge_shards(spark, d):
    """All ranks as shards: of each example the last one counts."""
    c = V.candidates(pairs(spark, d))
    return rerank.merge_prediction_shards(c.select(F.col("example_id").alias("id"), F.col("pred").alias("data"), F.col("beam_rank").alias("rank")))


def _corrupted(rows):
    joined = lambda c, sep: F.array_join(F.transform(c, lambda x: x.cast("string")), sep).alias(c)
    return rows.select("id", "noisy", "clean", "n_noise", joined("mask", ""), joined("labels", " "))


def q_corrupt_prose(spark, d):
    return _corrupted(pipelines.build_pretraining_pairs(V.clean_lines(spark, d), "nl"))


def q_corrupt_code(spark, d):
    return _corrupted(corrupt.corrupt(V.clean_lines(spark, d), "code"))


def q_apply_edit_plan(spark, d):
    """Code plans, rendered as text, taken apart again and replayed."""
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    p = pairs(spark, d).withColumn("ops", edits.edit_opcodes(old, new)).withColumn("plan", F.array_join(edits.code_edit_plan(F.col("ops"), old, new), " "))
    return p.select("example_id", plans.apply_edit_plan("code", old, T.tokens(F.col("plan"))).alias("text"))


def q_code_edit_plan(spark, d):
    """What a plan has on either side, and how many markers its commands have for old and new tokens."""
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    p = pairs(spark, d).withColumn("ops", edits.edit_opcodes(old, new))
    p = p.select("example_id", edits.code_edit_plan(F.col("ops"), old, new).alias("plan"), edits.edit_commands(F.col("ops"), old, new).alias("c"))
    side = lambda name: F.array_join(pipelines.plan_side(F.col("plan"), name), " ")
    count = lambda *marks: F.size(F.filter("c", lambda x: x.isin(*marks)))
    return p.select("example_id", side("old").alias("old_side"), side("new").alias("new_side"), count("<KEEP>", "<DELETE>", "<REPLACE_OLD>").alias("old_commands"), count("<KEEP>", "<INSERT>", "<REPLACE_NEW>").alias("new_commands"))


def _dataset_sides(rows, source):
    """What must hold for built examples: input and target; the plan without kept runs, so that its old tokens are
    fewer than the source's by as much as its new ones are than the target's; and the target behind it."""
    built = pipelines.build_edit_dataset(rows).join(rows.select("example_id", F.size(T.tokens(F.col(source))).alias("n")), "example_id")
    head = T.tokens(F.substring_index("model_output", " <s> ", 1))
    size = lambda side: F.size(pipelines.plan_side(head, side))
    return built.select(
        "example_id", "model_input", "target", F.expr("substr(model_output, instr(model_output, ' <s> ') + 5)").alias("behind_plan"),
        (F.col("n") - size("old") + size("new")).alias("new_size"), F.contains(F.col("model_output"), F.lit("<KEEP>")).alias("keeps"),
    )


def q_build_edit_dataset(spark, d):
    return _dataset_sides(pairs(spark, d), "source")


def q_phrase_positions(spark, d):
    words = T.tokens(F.col("source"))
    phrase = F.slice(words, F.greatest(F.size(words) / 2, F.lit(1)).cast("int"), 1)
    at = T.phrase_positions(words, phrase)
    return pairs(spark, d).select("example_id", F.size(at).alias("n"), F.array_join(F.transform(at, lambda x: x.cast("string")), ",").alias("positions"))


def q_metric_summary(spark, d):
    rows = V.eval_rows(spark, d)
    stats = metrics.overlap_stats(rows)
    long = (
        metrics.sentence_gleu(stats).select("example_id", F.lit("gleu").alias("metric"), F.col("gleu").alias("value"))
        .unionByName(metrics.sentence_bleu(stats).select("example_id", F.lit("bleu").alias("metric"), F.col("bleu_method2_higher_orders").alias("value")))
        .unionByName(rows.select("example_id", F.lit("exact").alias("metric"), (F.col("ref") == F.col("pred")).cast("double").alias("value")))
    )
    return long.groupBy("metric").agg(F.count("*").alias("examples"), F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("sd"))


def q_multi_bleu(spark, d):
    return metrics.multi_bleu(metrics.multi_ref_stats(V.eval_rows(spark, d).select("example_id", "pred"), V.refs_multi(pairs(spark, d))))


def q_gleu_resample(spark, d):
    rows = V.eval_rows(spark, d).select("example_id", "src", "pred")
    return metrics.gleu_resample(metrics.multi_ref_gleu_stats(rows, V.refs_multi(pairs(spark, d))))


def q_rouge_l(spark, d):
    return metrics.rouge_l(V.eval_rows(spark, d).select("example_id", "pred"), V.refs_multi(pairs(spark, d)))


def q_example_report(spark, d):
    best = rerank.rerank_best(*_split(spark, d)).select("example_id", "rerank_pred", "rerank_rank")
    return pipelines.inspect_outputs(V.eval_rows(spark, d)).join(best, "example_id")


def q_edit_opcodes(spark, d):
    """Opcodes as a table and what they must give together: either side in order, kept runs equal on both, and no two
    neighbours of the same kind."""
    p = pairs(spark, d).withColumn("o", T.tokens(F.col("source"))).withColumn("n", T.tokens(F.col("target"))).withColumn("ops", edits.edit_opcodes("o", "n"))
    t = p.select("example_id", "o", "n", F.posexplode_outer("ops").alias("op_idx", "op")).select("example_id", "o", "n", "op_idx", "op.*")
    cut = lambda c, a, b: F.array_join(F.slice(c, F.col(a) + 1, F.col(b) - F.col(a)), " ")
    t = edits.edit_neighbours(t.withColumn("old", cut("o", "o_start", "o_end")).withColumn("new", cut("n", "n_start", "n_end")), kind="tag")
    side = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("op_idx", c)))), lambda x: x[c]), " ")
    good = ((F.col("tag") != "equal") | (F.col("old") == F.col("new"))) & ~F.col("tag").eqNullSafe(F.col("next_kind"))
    return t.groupBy("example_id").agg(side("old").alias("old_side"), side("new").alias("new_side"), F.bool_and(F.coalesce(good, F.lit(True))).alias("well_formed"))


def _minimal(mode: str, view=pairs):
    """Plans of a mode, replayed, and whether the phrases that a minimal one names are unique in the old text."""
    def query(spark, d):
        old = T.tokens(F.col("source"))
        p = view(spark, d).withColumn("plan", plans.edit_plan(mode, old, T.tokens(F.col("target"))))
        text = plans.apply_edit_plan("minimal" if mode == "other" else mode, old, F.col("plan")).alias("text")
        if mode == "code":
            return p.select("example_id", text)
        spans = F.filter(F.split(F.array_join("plan", " "), r" ?<(?:INSERT|REPLACE)_NEW[A-Z_]*>[^<]*<(?:INSERT|REPLACE)_END> ?| ?<DELETE_END> ?"), lambda x: x != "")
        named = F.filter(F.transform(spans, lambda x: T.tokens(F.regexp_replace(x, "^<[A-Z_]*>", ""))), lambda x: F.size(x) > 0)
        held = cut(p.select("example_id", text, old.alias("words"), named.alias("phrases")))
        each = held.select("example_id", F.posexplode("phrases").alias("phrase_id", "phrase"))
        counts = phrases.phrase_counts(held, each).groupBy("example_id").agg(F.bool_and(F.col("places") == 1).alias("unique_phrases"))
        return held.join(counts, "example_id", "left").select("example_id", "text", F.coalesce("unique_phrases", F.lit(True)).alias("unique_phrases"))

    return query


def q_coarse_diff(spark, d):
    """Nodes of the coarse diff by kind, and how many children they have."""
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    p = pairs(spark, d).withColumn("ops", edits.edit_opcodes(old, new)).select("example_id", F.explode_outer(edits.coarse_diff(F.col("ops"), old, new)).alias("x")).select("example_id", "x.*")
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.size("children"))), F.lit(0))
    # A replacement's children are both sides and a marker.
    marks = F.coalesce(F.sum((F.col("kind") == "<REPLACE>").cast("int")), F.lit(0))
    both = 2 * n("<KEEP>") + n("<INSERT>", "<DELETE>", "<REPLACE>") - marks
    return p.groupBy("example_id").agg(both.alias("tokens"), F.coalesce(F.bool_and(F.col("kind").isin("<KEEP>", "<INSERT>", "<DELETE>", "<REPLACE>")), F.lit(True)).alias("known_kinds"))


def q_edit_token_labels(spark, d):
    """The labelled tokens of either side, in order."""
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    p = pairs(spark, d).withColumn("ops", edits.edit_opcodes(old, new)).select("example_id", plans.edit_token_labels(F.col("ops"), old, new).alias("l"))
    places = F.when(F.size("l") > 0, F.sequence(F.lit(0), F.size("l") - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    side = lambda *marks: F.array_join(F.transform(F.filter(places, lambda i: F.get("l", i).isin(*marks)), lambda i: F.get("l", i + 1)), " ")
    return p.select("example_id", side("<KEEP>", "<DELETE>", "<REPLACE_OLD>").alias("old_side"), side("<KEEP>", "<INSERT>", "<REPLACE_NEW>").alias("new_side"))


def q_reconstruct_predictions(spark, d):
    """Candidates' plans against their sources, replayed and scored: the k-best form of edit predictions."""
    both = V.candidates(pairs(spark, d)).join(pairs(spark, d), "example_id")
    made = both.withColumn("plan", F.array_join(plans.edit_plan("other", T.tokens(F.col("source")), T.tokens(F.col("pred"))), " "))
    examples = pairs(spark, d).select("example_id", T.render_model_input(F.col("source"), F.col("context")).alias("model_input"))
    back = pipelines.reconstruct_from_edit_predictions(examples, made.select("example_id", "beam_rank", F.col("plan").alias("pred")), "minimal")
    rows = made.select("example_id", "beam_rank", "target", F.col("pred").alias("want")).join(back, ["example_id", "beam_rank"])
    same = lambda a, b: F.sum((F.col(a) == F.col(b)).cast("int"))
    return rows.withColumn("want", T.empty_placeholder(F.col("want"))).groupBy("beam_rank").agg(F.count("*").alias("examples"), same("pred", "want").alias("restored"), same("pred", "target").alias("hits"))


def q_smoothed_bleu(spark, d):
    return metrics.sentence_bleu(metrics.overlap_stats(V.eval_rows(spark, d), 5), ("method3", "method4", "method5", "method6", "method7"))


def q_gleu_original(spark, d):
    return metrics.original_gleu(metrics.original_gleu_stats(V.eval_rows(spark, d).select("example_id", "src", "pred"), V.refs_multi(pairs(spark, d))))


def q_gleu_multiref(spark, d):
    rows = V.eval_rows(spark, d).select("example_id", "src", "pred")
    per = metrics.sentence_gleu(metrics.multi_ref_gleu_stats(rows, V.refs_multi(pairs(spark, d))))
    return metrics.score_spread(per, "gleu", ("example_id",))


def q_weighted_bleu(spark, d):
    stats = structure.recall_stats(V.eval_rows(spark, d))
    pair, true = (structure.weighted_corpus_bleu(stats, "method1", r) for r in ("pair", "true"))
    return pair.crossJoin(true.select(F.col("weighted_bleu").alias("weighted_bleu_true")))  # one row each


def q_syntax_match(spark, d):
    counts = structure.syntax_counts(V.subtrees(V.eval_rows(spark, d)))
    return counts.select("example_id", "s_match", "s_all")


def q_dataflow_match(spark, d):
    return structure.dataflow_counts(V.dataflow_edges(V.eval_rows(spark, d)))


def q_code_bleu(spark, d):
    rows = V.eval_rows(spark, d)
    return structure.code_bleu(structure.recall_stats(rows), V.subtrees(rows), V.dataflow_edges(rows))


def q_code_bleu_corpus(spark, d):
    rows = V.eval_rows(spark, d)
    return structure.corpus_code_bleu(structure.recall_stats(rows), V.subtrees(rows), V.dataflow_edges(rows))


def q_evaluation_summary(spark, d):
    """All metrics of a code data set, the code metric of every example joined in."""
    rows = V.eval_rows(spark, d)
    return metrics.evaluation_summary(rows, comment=False, code=q_code_bleu(spark, d))


def q_evaluation_summary_comment(spark, d):
    """The same of a comment data set, by sub-tokens; the metric of an outside program is supplied."""
    rows = V.eval_rows(spark, d)
    return metrics.evaluation_summary(rows, comment=True, meteor=rows.select("example_id", (F.length("pred") / F.greatest(F.length("ref"), F.lit(1))).alias("meteor")))


def q_evaluate_after_rerank(spark, d):
    best = rerank.rerank_best(*_split(spark, d))
    return pipelines.evaluate_after_rerank(best, V.eval_rows(spark, d))


def q_merge_and_evaluate(spark, d):
    """All ranks as shards: of each example the last one counts."""
    c = V.candidates(pairs(spark, d)).select(F.col("example_id").alias("id"), F.col("pred").alias("data"), F.col("beam_rank").alias("rank"))
    return pipelines.merge_and_evaluate(c, V.eval_rows(spark, d))


def q_inspect_rerank(spark, d):
    beams, scores = _split(spark, d)
    refs = pairs(spark, d).select("example_id", F.col("target").alias("ref"))
    return pipelines.inspect_rerank(beams, rerank.rerank_best(beams, scores), refs)


def q_keep_beams(spark, d):
    """The first three candidates of each example, none of which lacks one."""
    kept = rerank.keep_beams(V.candidates(pairs(spark, d)), 3)
    return kept.groupBy("example_id").agg(F.count("*").alias("n"), F.max("beam_rank").alias("last"), F.min_by("pred", "beam_rank").alias("first"))


def q_metric_pivot(spark, d):
    rows = V.eval_rows(spark, d)
    stats = metrics.overlap_stats(rows)
    long = metrics.sentence_gleu(stats).select("example_id", F.lit("gleu").alias("metric"), F.col("gleu").alias("value"))
    bleus = metrics.sentence_bleu(stats).select("example_id", F.lit("bleu").alias("metric"), F.col("bleu_method2_higher_orders").alias("value"))
    return metrics.metric_pivot(long.unionByName(bleus), ("bleu", "gleu"))


def _prepared(spark, d, with_plan: bool, comment: bool = False):
    examples = V.eval_rows(spark, d).select("example_id", "src", "ref", "ctx")
    return rerank.prepare_rerank(V.candidates(pairs(spark, d)).drop("second_score"), examples, with_plan, comment)


def q_prepare_rerank(spark, d):
    """What the scorer sees: the input, the candidate behind its plan, and the sizes that the plan must bridge."""
    rows = _prepared(spark, d, True)
    head = T.tokens(F.substring_index("seq_to_score", " <s> ", 1))
    size = lambda side: F.size(pipelines.plan_side(head, side))
    return rows.select(
        "example_id", "beam_rank", "full_src", F.expr("substr(seq_to_score, instr(seq_to_score, ' <s> ') + 5)").alias("scored"), "base_score",
        (F.size(T.tokens(F.col("src"))) - size("old") + size("new")).alias("new_size"),
    )


def q_prepare_rerank_comment(spark, d):
    """Comments lose their tags in source, reference and candidate first; here every text gets one in front."""
    tagged = lambda c: F.concat(F.lit("@return "), c).alias(c)
    examples = V.eval_rows(spark, d).select("example_id", tagged("src"), tagged("ref"), "ctx")
    beams = V.candidates(pairs(spark, d)).drop("second_score").withColumn("pred", F.concat(F.lit(" @param"), "pred"))
    return rerank.prepare_rerank(beams, examples, False, True).select("example_id", "beam_rank", "full_src", "seq_to_score", "ref")


def q_rerank_scored(spark, d):
    """Reranking by a supplied scorer, here one that likes outputs as long as their inputs; every score has its text."""
    rows = _prepared(spark, d, False)
    scores = rerank.score_candidates(rows, lambda: lambda a, b: -(a.str.len() - b.str.len()).abs() / (a.str.len() + 1.0))
    lost = rerank.unmatched_scores(rows, scores).select((F.col("unscored") + F.col("unknown") + F.col("other_text")).alias("unmatched"))  # one row
    return rerank.rerank(rows, scores).crossJoin(F.broadcast(lost))


def q_caption_suite(spark, d):
    return metrics.caption_suite(V.eval_rows(spark, d).select("example_id", "pred"), V.refs_multi(pairs(spark, d)))


def q_marker_classes(spark, d):
    """Every turn pair has one of the markers in front, by its id: their classes and numbers."""
    marks = F.array(*[F.lit(m) for m in sorted(T.EDIT_TOKENS)])
    rows = pairs(spark, d).select(F.explode(F.array(F.get(marks, F.pmod("example_id", F.lit(24)).cast("int")), F.lit("KEEPER"))).alias("t"))
    flags = ("insert", "keep", "replace", "delete", "start", "old", "new", "end")
    return rows.groupBy(F.col("t").alias("marker")).agg(F.count("*").alias("n"), *[F.max(T.marker_class(F.col("t"))[f].cast("int")).alias(f"is_{f}") for f in flags])


def q_java_token_table(spark, d):
    t = code.java_token_table(V.table(spark, d, "pages").select("page_id", "html"), "page_id", "html")
    return t.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.sum(F.length("token")).alias("chars"), F.min("token").alias("least"), F.max("token").alias("greatest"))


def q_remove_comments(spark, d):
    return V.table(spark, d, "pages").select("page_id", code.remove_comments(F.col("html")).alias("text"))


def _strip_tags(c: str) -> str:
    for tag in ("@return", "@ return", "@param", "@ param", "@throws", "@ throws"):
        c = f"trim(replace({c}, '{tag}', ''))"
    return c


def _strip(c: str) -> str:
    c = _strip_tags(c)
    for mark in ("/**", "**/", "/*", "*/", "*"):
        c = f"replace({c}, '{mark}', '')"
    c = f"regexp_replace(trim({c}), '<.*?>', '', 'g')"
    for mark in ("{", "}", "@code", "@docRoot", "@inheritDoc", "@link", "@linkplain", "@value"):
        c = f"replace({c}, '{mark}', '')"
    return c


def _sql_subtokens(c: str) -> str:
    found = rf"regexp_extract_all({_strip(c)}, '[a-zA-Z0-9]+|[^{V.SQL_BLANK}a-zA-Z0-9]')"
    return rf"array_to_string(list_transform(flatten(list_transform({found}, lambda x: string_split(regexp_replace(x, '([a-z0-9])([A-Z])', '\1 \2', 'g'), ' '))), lambda x: lower(x)), ' ')"


#: The twins' own list of markers, with what each is: insert, keep, replace, delete, start, old, new, end.
_MARKER_TABLE = """('<REPLACE>', 0,0,1,0, 1,0,0,0), ('<REPLACE_OLD>', 0,0,1,0, 1,1,0,0), ('<REPLACE_NEW>', 0,0,1,0, 0,0,1,0), ('<REPLACE_END>', 0,0,1,0, 0,0,0,1),
('<REPLACE_OLD_KEEP_BEFORE>', 0,1,1,0, 1,1,0,0), ('<REPLACE_NEW_KEEP_BEFORE>', 0,1,1,0, 0,0,1,0), ('<REPLACE_OLD_KEEP_AFTER>', 0,1,1,0, 1,1,0,0), ('<REPLACE_NEW_KEEP_AFTER>', 0,1,1,0, 0,0,1,0),
('<REPLACE_OLD_DELETE_KEEP_BEFORE>', 0,1,1,1, 1,1,0,0), ('<REPLACE_NEW_DELETE_KEEP_BEFORE>', 0,1,1,1, 0,0,1,0), ('<REPLACE_OLD_DELETE_KEEP_AFTER>', 0,1,1,1, 1,1,0,0), ('<REPLACE_NEW_DELETE_KEEP_AFTER>', 0,1,1,1, 0,0,1,0),
('<INSERT>', 1,0,0,0, 1,0,0,0), ('<INSERT_OLD>', 1,0,0,0, 1,1,0,0), ('<INSERT_NEW>', 1,0,0,0, 0,0,1,0), ('<INSERT_END>', 1,0,0,0, 0,0,0,1),
('<INSERT_OLD_KEEP_BEFORE>', 1,1,0,0, 1,1,0,0), ('<INSERT_NEW_KEEP_BEFORE>', 1,1,0,0, 0,0,1,0), ('<INSERT_OLD_KEEP_AFTER>', 1,1,0,0, 1,1,0,0), ('<INSERT_NEW_KEEP_AFTER>', 1,1,0,0, 0,0,1,0),
('<DELETE>', 0,0,0,1, 1,0,0,0), ('<DELETE_END>', 0,0,0,1, 0,0,0,1), ('<KEEP>', 0,1,0,0, 1,0,0,0), ('<KEEP_END>', 0,1,0,0, 0,0,0,1)"""
_MARKERS = f"select m from (values {_MARKER_TABLE}) x(m, a, b, c, d, e, f, g, h) union all select '<s>'"
_MARKER_LIST = ", ".join(re.findall("'<[A-Z_]+>'", _MARKER_TABLE)) + ", '<s>'"
_DRAW = "(('0x' || substr(md5({}), 1, 8))::bigint / 4294967296.0::double)"


def _sql_corrupt(modality: str) -> str:
    noise, length = {"nl": (4, 3.0), "code": (12, 6.5)}[modality]
    spans = max(1, round(noise / length))
    low, high = {"nl": (0.07, 0.18), "code": (0.495, 0.71)}[modality]
    action = lambda k: _DRAW.format(f"'20:' || id || ':action:{k}'")
    cut = lambda what, total: f"(floor({_DRAW.format(f"'20:' || id || ':{what}'")} * ({total} - 1))::int + 1)"
    plain, noisy = ["p1", "(size - noise - p1)"][:spans], ["q1", "(noise - q1)"][:spans]
    parts, labels, mask, at = [], [], [], "0"
    run = lambda x, n: f"list_transform(range(0, {n}), lambda z: {x})"
    for k in range(spans):
        own = f"t[{at} + {plain[k]} + 1:{at} + {plain[k]} + {noisy[k]}]"
        shown = f"case when {noisy[k]} > 1 then {own} else [] end"
        parts.append(f"t[{at} + 1:{at} + {plain[k]}]")
        # A span that the line has no room for is empty.
        pick = lambda a, b, c, k=k: f"case when {noisy[k]} = 0 then [] when {action(k)} < {low} then {a} when {action(k)} < {high} then {b} else {c} end"
        parts.append(pick(f"list_concat(['<extra_id_{k}>'], {shown})", "[]", f"['<extra_id_{k}>']"))
        kept = run("'<KEEP>'", plain[k])
        fewer = run("'<KEEP>'", f"{plain[k]} - 1")
        none = "[]::varchar[]"
        labels.append(f"case when {noisy[k]} = 0 then {none} when {action(k)} < {low} then list_concat(list_concat({kept}, ['<DELETE>']), {run("'<KEEP>'", f'len({shown})')}) when {action(k)} < {high} then list_concat({fewer}, ['<INSERT>']) else list_concat({kept}, ['<REPLACE>']) end")
        mask += [f"repeat('0', ({plain[k]})::int)", f"repeat('1', ({noisy[k]})::int)"]
        at = f"{at} + {plain[k]} + {noisy[k]}"
    whole = reduce(lambda a, b: f"list_concat({a}, {b})", parts)
    lines = f"select doc_id as id, {V._ws('text')} as text from documents union all select -1 - item_id, {V._ws('text')} from benchmark"
    return f"""with l as (select id, {V._TOK.format('text')} as t from ({lines})),
s as (select id, t, len(t) as size, least({noise}, len(t) - 1) as noise from l where len(t) between 2 and 512),
k as (select *, greatest(1, round_even(noise / {length}::double, 0)) as spans from s),
c as (select *, case when spans = 1 then size - noise else {cut('plain', '(size - noise)')} end as p1, case when spans = 1 then noise else {cut('noise', 'noise')} end as q1
  from k where noise >= spans and size - noise >= spans)
select id, array_to_string({whole}, ' ') as noisy, array_to_string(t, ' ') as clean, noise::int as n_noise, {' || '.join(mask)} as mask, array_to_string({reduce(lambda a, b: f"list_concat({a}, {b})", labels)}, ' ') as labels from c"""


_CIDER = V.SQL_REFS + f""", long as (
  select example_id, -1 as ref_idx, {V._TOK.format('pred')} as t from evals union all select example_id, ref_idx, {V._TOK.format('ref')} from refs
), g as (
  select example_id, ref_idx, n, gram, count(*) as c from (
    select example_id, ref_idx, n, array_to_string(t[i:i + n - 1], chr(1)) as gram
    from (select *, unnest(range(1, len(t) - n + 2)) as i from long, (values (1), (2), (3), (4)) k(n))) group by all
), df as (select gram, count(distinct example_id) as df from g where ref_idx >= 0 group by gram),
w as (
  select g.*, c * (ln((select count(distinct example_id) from refs)) - ln(greatest(1, coalesce(df, 0)))) as w from g left join df using (gram)
), nrm as (select example_id, ref_idx, n, sqrt(sum(w * w)) as nrm from w group by all),
dot as (
  select r.example_id, r.ref_idx, r.n, sum(least(h.w, r.w) * r.w) as dot from w r join w h on h.ref_idx = -1 and r.ref_idx >= 0
    and h.example_id = r.example_id and h.n = r.n and h.gram = r.gram group by all
), cs as (
  select d.example_id, d.ref_idx, sum(case when a.nrm > 0 and b.nrm > 0 then dot / (a.nrm * b.nrm) else dot end) / 4 as v
  from dot d join nrm a on a.example_id = d.example_id and a.n = d.n and a.ref_idx = -1
  join nrm b on b.example_id = d.example_id and b.n = d.n and b.ref_idx = d.ref_idx group by d.example_id, d.ref_idx
), ln as (select example_id, ref_idx, greatest(len(t) - 1, 0) as b from long)
select r.example_id, round(avg(coalesce(v, 0) * exp(-((h.b - r.b) * (h.b - r.b)) / 72.0::double)) * 10, 6) as cider
from ln r join ln h on h.example_id = r.example_id and h.ref_idx = -1 and r.ref_idx >= 0
left join cs on cs.example_id = r.example_id and cs.ref_idx = r.ref_idx group by r.example_id"""

_SARI_SIDES = {k: V._TOK.format(f"lower({c})") for k, c in (("src", "src"), ("ref", "ref"), ("hyp", "pred"))}
_SARI = V.SQL_EVAL + "," + _GRAMS.format(**_SARI_SIDES) + """, per as (
  select example_id, n,
    coalesce(avg(case when least(c_src, c_hyp) > 0 then least(c_src, c_hyp, c_ref)::double / least(c_src, c_hyp) end), 0) as kp,
    coalesce(avg(case when least(c_src, c_ref) > 0 then least(c_src, c_hyp, c_ref)::double / least(c_src, c_ref) end), 0) as kr,
    coalesce(avg(case when c_src > c_hyp then greatest(c_src - c_hyp - c_ref, 0)::double / (c_src - c_hyp) end), 0) as dp,
    count(*) filter (c_hyp > 0 and c_src = 0) as a, count(*) filter (c_hyp > 0 and c_src = 0 and c_ref > 0) as ag, count(*) filter (c_ref > 0 and c_src = 0) as aa
  from grams group by example_id, n
), pr as (select *, case when a > 0 then ag::double / a else 0 end as p, case when aa > 0 then ag::double / aa else 0 end as r from per),
sc as (
  select example_id, sum(case when kp + kr > 0 then 2 * kp * kr / (kp + kr) else 0 end) / 4 as keep, sum(dp) / 4 as del,
    sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end) / 4 as add from pr group by example_id
)
select e.example_id, round((coalesce(keep, 0) + coalesce(del, 0) + coalesce(add, 0)) / 3 * 100 + 1e-9, 6) as sari,
  round(coalesce(keep, 0) + 1e-9, 6) as sari_keep, round(coalesce(del, 0) + 1e-9, 6) as sari_del, round(coalesce(add, 0) + 1e-9, 6) as sari_add
from evals e left join sc using (example_id)"""

_ONE = {"one_r": "any_value(case when rlen = 0 then 1 else rlen end)", "one_h": "any_value(case when hlen = 0 then 1 else hlen end)",
        "one_num": "(case when greatest(num - pen, 0) = 0 then 1 else num - pen end)", "one_den": "(case when den = 0 then 1 else den end)"}
_SENT_GLEU = f"select example_id, round({_SQL_GLEU.format(**_ONE)}, 6) as gleu from per group by example_id"
_SENT_BLEU = "select example_id, {} from (select *, greatest(den, 1) as gd from per) group by example_id"

_MULTI_BLEU = V.SQL_REFS + f""", h as (select example_id, {V._TOK.format('pred')} as t from evals),
hg as (select example_id, n, gram, count(*) as c from (select example_id, n, array_to_string(t[i:i + n - 1], chr(1)) as gram
  from (select *, unnest(range(1, len(t) - n + 2)) as i from h, (values (1), (2), (3), (4)) k(n))) group by all),
rg as (select example_id, n, gram, max(c) as c from (select example_id, ref_idx, n, gram, count(*) as c from (
  select example_id, ref_idx, n, array_to_string(t[i:i + n - 1], chr(1)) as gram
  from (select *, unnest(range(1, len(t) - n + 2)) as i from (select example_id, ref_idx, {V._TOK.format('ref')} as t from refs), (values (1), (2), (3), (4)) k(n)))
  group by all) group by all),
m as (select example_id, n, sum(least(hg.c, rg.c)) as num from hg join rg using (example_id, n, gram) group by all),
l as (select h.example_id, len(h.t) as hlen, min((abs(len({V._TOK.format('ref')}) - len(h.t)), len({V._TOK.format('ref')})))[2] as rlen from h join refs using (example_id) group by all),
p as (select l.*, k.n, (coalesce(num, 0) + 1e-15::double) / (greatest(hlen - k.n + 1, 0) + 1e-9::double) as p, (hlen + 1e-15::double) / (rlen + 1e-9::double) as ratio
  from l cross join (values (1), (2), (3), (4)) k(n) left join m on m.example_id = l.example_id and m.n = k.n),
b as (select example_id, ratio, case when ratio < 1 then exp(1 - 1 / ratio) else 1.0 end as bp, max(case when n = 1 then p end) as p1, max(case when n = 2 then p end) as p2,
  max(case when n = 3 then p end) as p3, max(case when n = 4 then p end) as p4 from p group by all)
select example_id, round(p1 * bp, 6) as bleu_1, round(pow(p1 * p2, 1 / 2.0::double) * bp, 6) as bleu_2, round(pow(p1 * p2 * p3, 1 / 3.0::double) * bp, 6) as bleu_3,
  round(pow(p1 * p2 * p3 * p4, 0.25::double) * bp, 6) as bleu_4, round(ratio, 6) as length_ratio from b"""

_RESAMPLE = V.SQL_REFS + f""", sides as (
  select example_id, -1 as ref_idx, 'src' as side, {_TOKENS['src']} as t from evals union all select example_id, -1, 'hyp', {_TOKENS['hyp']} from evals
  union all select example_id, ref_idx, 'ref', {V._TOK.format('ref')} from refs
), g as (select example_id, ref_idx, side, n, gram, count(*) as c from (select example_id, ref_idx, side, n, array_to_string(t[i:i + n - 1], chr(1)) as gram
  from (select *, unnest(range(1, len(t) - n + 2)) as i from sides, (values (1), (2), (3), (4)) k(n))) group by all),
m as (
  select h.example_id, x.ref_idx, h.n, sum(least(h.c, coalesce(r.c, 0))) as num, sum(case when r.c is null then least(h.c, coalesce(s.c, 0)) else 0 end) as pen
  from g h join (values (0), (1), (2)) x(ref_idx) on h.side = 'hyp'
  left join g r on r.side = 'ref' and r.example_id = h.example_id and r.ref_idx = x.ref_idx and r.n = h.n and r.gram = h.gram
  left join g s on s.side = 'src' and s.example_id = h.example_id and s.n = h.n and s.gram = h.gram group by all
), st as (
  select r.example_id, r.ref_idx, k.n, len({_TOKENS['hyp']})::double as hlen, len({V._TOK.format('r.ref')})::double as rlen,
    greatest(coalesce(num, 0) - coalesce(pen, 0), 0)::double as num, greatest(len({_TOKENS['hyp']}) + 1 - k.n, 0)::double as den
  from refs r join evals e using (example_id) cross join (values (1), (2), (3), (4)) k(n)
  left join m on m.example_id = r.example_id and m.ref_idx = r.ref_idx and m.n = k.n
), pk as (select i as iteration, example_id, ('0x' || substr(md5('0:' || i || ':' || example_id), 1, 8))::bigint % 3 as ref_idx from range(500) t(i), (select example_id from evals)),
s as (select iteration, n, sum(hlen) as hlen, sum(rlen) as rlen, sum(num) as num, sum(den) as den from pk join st using (example_id, ref_idx) group by all),
gl as (select iteration, case when min(least(num, den, hlen, rlen)) = 0 then 0.0 else exp(least(0.0, 1 - any_value(rlen) / any_value(hlen)) + avg(ln(num / den))) end as g from s group by iteration)
select count(*) as iterations, round(avg(g), 6) as mean, round(stddev_pop(g), 6) as sd, round(avg(g) - 1.959964 * stddev_pop(g), 6) as low, round(avg(g) + 1.959964 * stddev_pop(g), 6) as high from gl"""

_GRAMS_OF = "select example_id, side, n, array_to_string(t[i:i + n - 1], chr(1)) as gram from (select *, unnest(range(1, len(t) - n + 2)) as i from {}, (values (1), (2), (3), (4)) k(n))"
_ORIGINAL = V.SQL_REFS + f""", sides as (
  select example_id, 'src' as side, {_TOKENS['src']} as t from evals union all select example_id, 'hyp', {_TOKENS['hyp']} from evals
  union all select example_id, 'r' || ref_idx, {V._TOK.format('ref')} from refs
), g as (select example_id, side, n, gram, count(*) as c from ({_GRAMS_OF.format('sides')}) group by all),
m as (select example_id, n, gram, coalesce(max(c) filter (side = 'hyp'), 0) as h, coalesce(max(c) filter (side = 'src'), 0) as s, coalesce(max(c) filter (side like 'r_'), 0) as r from g group by all),
p as (select example_id, n, sum(case when s = 0 then least(h, r) else 0 end) as own, sum(least(h, r)) as num, sum(case when r = 0 then least(h, s) else 0 end) as pen from m group by all),
l as (select e.example_id, len({_TOKENS['hyp']}) as hlen, arg_min(len({V._TOK.format('refs.ref')}), (abs(len({V._TOK.format('refs.ref')}) - len({_TOKENS['hyp']})), ref_idx)) as rlen
  from evals e join refs using (example_id) group by all),
s as (select lam, k.n, sum(coalesce(own, 0) + greatest(coalesce(num, 0) - lam * coalesce(pen, 0), 0))::double as num, sum(coalesce(own, 0) + greatest(hlen + 1 - k.n, 0))::double as den, sum(hlen)::double as hlen, sum(rlen)::double as rlen
  from l cross join (values (1), (2), (3), (4)) k(n) cross join (values (0.0::double), (0.5::double), (1.0::double)) x(lam) left join p on p.example_id = l.example_id and p.n = k.n group by lam, k.n)
select lam as lambda, round(case when min(least(num, den, hlen, rlen)) = 0 then 0.0 else exp(least(0.0, 1 - any_value(hlen) / any_value(rlen)) + avg(ln(num / den))) end, 6) as gleu_original from s group by lam"""
_KEYWORD_LIST = ", ".join(
    f"'{w}'" for w in "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while".split()
)
_CODE_STATS = SQL_STATS + f""", rec as (
  select example_id, n, sum(least(c_ref, c_hyp) * w)::double as rnum, sum(c_ref * w)::double as rden
  from (select *, case when n > 1 or gram in ({_KEYWORD_LIST}) then 1.0::double else 0.2::double end as w from grams) group by example_id, n
), cs as (
  select p.example_id, p.n, hlen, rlen, num, greatest(den, 1) as den, coalesce(rnum, 0) as rnum, greatest(coalesce(rden, 0), 1) as rden from per p left join rec r on r.example_id = p.example_id and r.n = p.n
)"""
_M1 = "exp(avg(ln(case when {num} = 0 then 0.1 / {den} else {num} / {den} end)))"


def _sql_m1(num: str, den: str, rlen: str) -> str:
    bp = f"any_value(case when hlen > {rlen} then 1.0 when hlen = 0 then 0.0 else exp(1 - {rlen} / greatest(hlen, 1)) end)"
    return f"case when max(case when n = 1 then {num} end) = 0 then 0.0 else {bp} * {_M1.format(num=num, den=den)} end"


_CORPUS_CODE = _CODE_STATS + ", su as (select n, sum(num) as num, sum(den) as den, sum(rnum) as rnum, sum(rden) as rden, sum(hlen) as hlen, sum(rlen) as rlen, count(*) as examples from cs group by n)"
_SUBTREES = f""", sd as (select example_id, 'ref' as side, {_TOKENS['ref']} as t from evals union all select example_id, 'hyp', {_TOKENS['hyp']} from evals),
trees as (select example_id, side, '(' || t[i] || ' (' || t[i + 1] || '))' as sexp from (select *, unnest(range(1, len(t))) as i from sd)),
syn as (select example_id, sum(case when h > 0 then r else 0 end)::bigint as s_match, sum(r)::bigint as s_all from (
  select example_id, sexp, count(*) filter (side = 'ref') as r, count(*) filter (side = 'hyp') as h from trees group by all) group by example_id)"""
_EDGES = """, tk as (select example_id, side, t, unnest(range(0, len(t))) as i from sd),
raw as (
  select example_id, side, i as pos, t[i + 1] as var, 'comesFrom' as relation, case when i % 3 <> 0 then [t[i]] else []::varchar[] end as sv, case when i % 3 <> 0 then [i - 1] else []::bigint[] end as sp from tk
  union all select example_id, side, i, t[i + 1], 'computedFrom', [t[i - 2]], [i - 3] from tk where i % 5 = 4
), used as (select distinct example_id, side, unnest(sp) as pos from raw),
kept as (select r.* from raw r left join used u using (example_id, side, pos) where len(sp) > 0 or u.pos is not null),
mg as (select example_id, side, pos, any_value(var) as var, max(relation) as relation, list_sort(list_distinct(flatten(list(sv)))) as sv from kept group by example_id, side, pos),
nm as (select *, unnest(list_concat(sv, [var])) as name, unnest(range(0, len(sv) + 1)) as k from mg),
fs as (select example_id, side, name, row_number() over (partition by example_id, side order by min((pos, k))) - 1 as rnk from nm group by example_id, side, name),
ed as (select example_id, side, pos, any_value(relation) || ' ' || string_agg('var_' || rnk, ' ' order by k) as edge from nm join fs using (example_id, side, name) group by example_id, side, pos),
df as (select example_id, sum(least(r, h))::bigint as d_match, sum(r)::bigint as d_all from (
  select example_id, edge, count(*) filter (side = 'ref') as r, count(*) filter (side = 'hyp') as h from ed group by all) group by example_id)"""
_COMBINE = "round(100 * (coalesce(ngram, 0) + coalesce(weighted, 0) + coalesce(syntax, 0) + coalesce(dataflow, 0)) / ((ngram is not null)::int + (weighted is not null)::int + (syntax is not null)::int + (dataflow is not null)::int), 6) as code_bleu"
_PARTS = "round(ngram, 6) as ngram, round(weighted, 6) as weighted, round(syntax, 6) as syntax, round(dataflow, 6) as dataflow, " + _COMBINE
_SHARES = "case when s_all > 0 then s_match::double / s_all end as syntax, case when d_all > 0 then d_match::double / d_all end as dataflow"


# The twins' own patterns of the language, and words by kind.
_JAVA_WORD, _JAVA_SIGN = r"[\p{L}_$][\p{L}\p{Nd}_$]*", r">>>=|>>=|<<=|\+\+|--|->|::|==|!=|<=|>=|&&|\|\||<<|\+=|-=|\*=|/=|&=|\|=|\^=|%=|[-+*/%&|^<>=!~?:]"
_JAVA_TOKEN = (
    r"""//[^\n]*|/\*(?s:.*?)\*/|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'|0[xX][0-9a-fA-F_]+[lL]?|0[bB][01_]+[lL]?"""
    r"""|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?[fFdDlL]?|""" + _JAVA_WORD + r"""|\.\.\.|[(){}\[\];,.@]|""" + _JAVA_SIGN + r"""|[^ \t\n\r\f]"""
)
_JAVA_BASIC = "'boolean', 'byte', 'char', 'double', 'float', 'int', 'long', 'short'"
_JAVA_MODIFIERS = "'abstract', 'default', 'final', 'native', 'private', 'protected', 'public', 'static', 'strictfp', 'synchronized', 'transient', 'volatile'"
_C_PIECES = r"""//[^\n]*|/\*(?s:.*?)\*/|'[^\\']*(?:\\(?s:.)[^\\']*)*'|"[^\\"]*(?:\\(?s:.)[^\\"]*)*"|[^/'"]+|[/'"]"""


def _sql_kind(t: str) -> str:
    return rf"""case when regexp_matches({t}, '^/[/*]') then 'comment' when regexp_matches({t}, '^("[^\n]*"|''[^\n]*'')$') then 'string' when regexp_matches({t}, '^\.?[0-9]') then 'number'
  when {t} in ('true', 'false') then 'boolean' when {t} = 'null' then 'null' when {t} in ({_JAVA_BASIC}) then 'basic_type' when {t} in ({_JAVA_MODIFIERS}) then 'modifier' when {t} in ({_KEYWORD_LIST}) then 'keyword'
  when regexp_matches({t}, '^{_JAVA_WORD}$') then 'identifier' when {t} = '@' then 'annotation' when {t} in ('(', ')', '{{', '}}', '[', ']', ';', ',', '.', '...') then 'separator'
  when regexp_matches({t}, '^({_JAVA_SIGN})$') then 'operator' else 'stray' end"""


_JAVA_TABLE = f"""with l as (select page_id, list_filter(regexp_extract_all(html, '{_JAVA_TOKEN.replace("'", "''")}'), lambda x: not regexp_matches(x, '^/[/*]')) as t from pages),
x as (select page_id, unnest(t) as token, unnest(range(0, len(t))) as pos from l)
select page_id, {_sql_kind('token')} as kind, count(*) as n, max(pos)::int as last, sum(length(token))::bigint as chars, min(token) as least, max(token) as greatest from x group by 1, 2"""
_COMMENTS = f"""select page_id, array_to_string(list_filter(string_split(array_to_string(list_transform(regexp_extract_all(html, '{_C_PIECES.replace("'", "''")}'),
  lambda p: case when regexp_matches(p, '^/[/*]') then ' ' else p end), ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\r\f]')), chr(10)) as text from pages"""
_SUMMARY = f"""with {SQL_STATS}, g as ({_SENT_GLEU}), b as ({_SENT_BLEU.format(_sql_bleu('method2_higher_orders'))}), s as (with {_SARI})
select count(*) as examples, round(avg(bleu_method2_higher_orders), 6) as bleu, round(avg((ref = pred)::int) * 100, 6) as acc_top_1, round(avg(sari), 6) as sari, round(avg(gleu) * 100, 6) as gleu,
  -1.0::double as code_bleu, -1.0::double as meteor, round(avg((src = pred)::int) * 100, 6) as copy_pct from evals join g using (example_id) join b using (example_id) join s using (example_id)"""

QUERIES = {
    "edit_opcodes": (q_edit_opcodes, None),
    "minimal_edit_plan": (_minimal("other"), None),
    "comment_edit_plan": (_minimal("comment"), None),
    "replay_code_plan": (_minimal("code"), None),
    "edit_token_labels": (q_edit_token_labels, None),
    "reconstruct_predictions": (q_reconstruct_predictions, None),
    "smoothed_bleu": (q_smoothed_bleu, None),
    "gleu_original": (q_gleu_original, f"with {_ORIGINAL}"),
    "gleu_multiref": (q_gleu_multiref, None),
    "weighted_bleu": (q_weighted_bleu, f"with {_CORPUS_CODE} select any_value(examples) as examples, round({_sql_m1('rnum', 'rden', '2.0 * examples')}, 6) as weighted_bleu, round({_sql_m1('rnum', 'rden', 'rlen')}, 6) as weighted_bleu_true from su"),
    "syntax_match": (q_syntax_match, f"with {V.SQL_EVAL}{_SUBTREES} select * from syn"),
    "dataflow_match": (q_dataflow_match, f"with {V.SQL_EVAL}{_SUBTREES}{_EDGES} select * from df"),
    "code_bleu": (q_code_bleu, f"with {_CODE_STATS}{_SUBTREES}{_EDGES}, z as (select example_id, {_sql_m1('num', 'den', 'rlen')} as ngram, {_sql_m1('rnum', 'rden', '2.0')} as weighted from cs group by example_id), y as (select z.*, {_SHARES} from z left join syn using (example_id) left join df using (example_id)) select example_id, {_PARTS} from y"),
    "code_bleu_corpus": (q_code_bleu_corpus, f"with {_CORPUS_CODE}{_SUBTREES}{_EDGES}, z as (select any_value(examples) as examples, {_sql_m1('num', 'den', 'rlen')} as ngram, {_sql_m1('rnum', 'rden', '2.0 * examples')} as weighted from su), t as (select sum(s_match) as s_match, sum(s_all) as s_all from syn), u as (select sum(d_match) as d_match, sum(d_all) as d_all from df), y as (select z.*, {_SHARES} from z, t, u) select examples, {_PARTS} from y"),
    "evaluation_summary": (q_evaluation_summary, _SUMMARY),
    "metric_pivot": (q_metric_pivot, f"with {SQL_STATS}, g as ({_SENT_GLEU}), b as ({_SENT_BLEU.format(_sql_bleu('method2_higher_orders'))}) select example_id, bleu_method2_higher_orders as bleu, gleu from g join b using (example_id)"),
    "prepare_rerank": (q_prepare_rerank, None),
    "rerank_scored": (q_rerank_scored, None),
    "caption_suite": (q_caption_suite, None),
    "marker_classes": (q_marker_classes, None),
    "java_token_table": (q_java_token_table, _JAVA_TABLE),
    "remove_comments": (q_remove_comments, _COMMENTS),
    "multi_bleu": (q_multi_bleu, f"with {_MULTI_BLEU}"),
    "gleu_resample": (q_gleu_resample, f"with {_RESAMPLE}"),
    "rouge_l": (q_rouge_l, None),
    "example_report": (q_example_report, f"with {SQL_STATS}, g as ({_SENT_GLEU}), b as ({_SENT_BLEU.format(_sql_bleu('method2_higher_orders'))}), k as (select example_id, arg_max(pred, (base_score + second_score, -beam_rank)) as rerank_pred, arg_max(beam_rank, (base_score + second_score, -beam_rank)) as rerank_rank from candidates group by example_id) select example_id, src, ref, pred, pred = src as no_changes, gleu, bleu_method2_higher_orders, rerank_pred, rerank_rank from evals join g using (example_id) join b using (example_id) join k using (example_id)"),
    "normalize_ws": (q_normalize_ws, f"select doc_id, {V._ws('text')} as text from documents"),
    "subtokenize_comment": (q_subtokenize_comment, f"select doc_id, {_sql_subtokens('text')} as text from documents"),
    "split_render_input": (q_split_render_input, f"with {V.SQL_PAIRS} select example_id, trim(source) || ' </s> ' || trim(context || '</s>' || target) as model_input from pairs"),
    "remove_keep_span": (q_remove_keep_span, f"with {_SQL_MARKED} select example_id, {V._ws("regexp_replace(t, '<KEEP>(.|\n)*?<KEEP_END>', '', 'g')")} as text from marked"),
    "remove_edits": (q_remove_edits, f"with {_SQL_MARKED}, w as (select *, {V._TOK.format(V._ws('t'))} as w from marked), p as (select *, list_max(list_transform(range(1, len(w) + 1), lambda i: case when w[i] in ({_MARKER_LIST}) then i else 0 end)) as place from w) select example_id, array_to_string(w[place + 1:], ' ') as text, array_to_string(w[place + 1:], ' ') as gen, length(array_to_string(w[:place], ' '))::bigint as edit_chars from p"),
    "exact_match": (q_exact_match, f"with {V.SQL_CANDIDATES} select beam_rank, round(avg((pred = target)::int) * 100, 6) as exact_match from candidates join pairs using (example_id) group by beam_rank"),
    "copy_pct": (q_copy_pct, f"with {V.SQL_EVAL} select count(*) as examples, round(avg(({_sql_subtokens('src')} = {_sql_subtokens('pred')})::int) * 100, 6) as copy_pct, round(avg((ctx = pred)::int) * 100, 6) as context_pct from evals"),
    "ngram_counts": (q_ngram_counts, f"with l as (select doc_id, {V._TOK.format(V._ws('text'))} as t from documents), g as (select doc_id, n, array_to_string(t[i:i + n - 1], chr(1)) as gram, count(*) as c from (select *, unnest(range(1, len(t) - n + 2)) as i from l, (values (1), (2), (3), (4)) k(n)) group by all) select doc_id, n::int as n, count(*) as grams, sum(c)::bigint as total, max(c) as most from g group by doc_id, n"),
    "sentence_bleu": (q_sentence_bleu, f"with {SQL_STATS} " + _SENT_BLEU.format(", ".join(_sql_bleu(m) for m in ("method0", "method1", "method2", "method2_higher_orders")))),
    "corpus_bleu": (q_corpus_bleu, f"with {SQL_STATS}, s as (select n, sum(num) as num, sum(greatest(den, 1)) as den, sum(hlen) as hlen, sum(rlen) as rlen, count(*) as examples from per group by n) select any_value(examples) as examples, round(case when max(case when n = 1 then num end) = 0 then 0.0 else any_value({_BP}) * exp(avg(ln(case when num = 0 then 0.1 / den else num / den end))) end, 6) as corpus_bleu from s"),
    "gleu": (q_gleu, f"with {SQL_STATS}, g as ({_SENT_GLEU}) select example_id, gleu, (ref = pred)::int as exact from g join evals using (example_id)"),
    "gleu_corpus": (q_gleu_corpus, f"with {SQL_STATS}, s as (select n, sum(greatest(num - pen, 0)) as num, sum(den) as den, sum(hlen) as hlen, sum(rlen) as rlen from per group by n) select round(case when min(least(num, den, hlen, rlen)) = 0 then 0.0 else exp(least(0.0, 1 - any_value(rlen) / any_value(hlen)) + avg(ln(num / den))) end, 6) as corpus_gleu from s"),
    "sari": (q_sari, f"with {_SARI}"),
    "cider": (q_cider, f"with {_CIDER}"),
    "rerank_best": (q_rerank_best, f"with {V.SQL_CANDIDATES} select example_id, arg_max(pred, (base_score, -beam_rank)) as top1, arg_max(pred, (base_score + second_score, -beam_rank)) as rerank_pred, arg_max(beam_rank, (base_score + second_score, -beam_rank)) as rerank_rank from candidates group by example_id"),
    "rerank_hits": (q_rerank_hits, f"with {V.SQL_CANDIDATES}, b as (select example_id, arg_max(pred, (base_score, -beam_rank)) as top1, arg_max(pred, (base_score + second_score, -beam_rank)) as best, list(pred) as preds from candidates group by example_id) select count(*) as examples, sum((top1 = target)::int)::bigint as top1_hits, sum((best = target)::int)::bigint as rerank_hits, sum(list_contains(preds, target)::int)::bigint as any_hits from b join pairs using (example_id)"),
    "collect_beams": (q_collect_beams, f"with {V.SQL_CANDIDATES} select example_id, string_agg(pred, chr(10) order by beam_rank) as beams, count(*)::int as k from candidates group by example_id"),
    "merge_shards": (q_merge_shards, f"with {V.SQL_CANDIDATES} select example_id as id, arg_max(pred, beam_rank) as data from candidates where beam_rank = 0 or (beam_rank = 1 and example_id % 2 = 0) group by example_id"),
    "corrupt_prose": (q_corrupt_prose, _sql_corrupt("nl")),
    "corrupt_code": (q_corrupt_code, _sql_corrupt("code")),
    "apply_edit_plan": (q_apply_edit_plan, f"with {V.SQL_PAIRS} select example_id, target as text from pairs"),
    "code_edit_plan": (q_code_edit_plan, None),
    "build_edit_dataset": (q_build_edit_dataset, None),
    "phrase_positions": (q_phrase_positions, f"with {V.SQL_PAIRS}, w as (select example_id, {V._TOK.format('source')} as w from pairs), p as (select example_id, w, w[greatest(len(w) // 2, 1)] as x from w), l as (select example_id, list_filter(range(0, len(w)), lambda i: w[i + 1] = x) as places from p) select example_id, len(places)::int as n, array_to_string(places, ',') as positions from l"),
    "metric_summary": (q_metric_summary, f"with {SQL_STATS}, g as ({_SENT_GLEU}), b as ({_SENT_BLEU.format(_sql_bleu('method2_higher_orders'))}), l as (select 'gleu' as metric, gleu as value from g union all select 'bleu', bleu_method2_higher_orders from b union all select 'exact', (ref = pred)::int::double from evals) select metric, count(*) as examples, round(avg(value), 5) as mean, round(stddev_pop(value), 5) as sd from l group by metric"),
}
