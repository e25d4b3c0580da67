"""The user-level jobs: building edit data, judging generations, reranking; compositions of the other operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import corrupt, edits, metrics, plans, rerank


def build_edit_dataset(rows: DataFrame) -> DataFrame:
    """(example_id, model_input, model_output, target): the rendered input, and the plan of changes before the target.

    rows: example_id, source, target, context. Blanks are evened; no row moves.
    """
    even = rows.select("example_id", *[T.normalize_ws(F.col(c)).alias(c) for c in ("source", "target", "context")])
    old, new = T.tokens(F.col("source")), T.tokens(F.col("target"))
    plan = T.remove_keep_span(F.array_join(edits.code_edit_plan(F.col("ops"), old, new), " "))
    return even.withColumn("ops", edits.edit_opcodes(old, new)).select(
        "example_id", T.render_model_input(F.col("source"), F.col("context")).alias("model_input"), T.render_edit_target(plan, F.col("target")).alias("model_output"), "target"
    )


def build_pretraining_pairs(lines: DataFrame, modality: str = "nl", seed: int = 20) -> DataFrame:
    """corrupt over prose, or over the tokens of source code. lines: id, text."""
    return corrupt.corrupt_code(lines, seed) if modality == "code" else corrupt.corrupt(lines, modality, seed)


def reconstruct_from_edit_predictions(examples: DataFrame, beams: DataFrame, mode: str = "comment") -> DataFrame:
    """(example_id, beam_rank, edit_pred, pred): candidates that are plans, replayed on their sources; an empty text is
    <EMPTY>. examples: example_id, model_input; beams: example_id, beam_rank, pred."""
    source, _ = T.split_model_input(F.col("model_input"), True)
    rows = beams.join(examples.select("example_id", T.tokens(source).alias("old")), "example_id")
    text = T.empty_placeholder(plans.apply_edit_plan(mode, F.col("old"), T.tokens(F.col("pred"))))
    return rows.select("example_id", "beam_rank", F.col("pred").alias("edit_pred"), text.alias("pred"))


def example_scores(rows: DataFrame) -> DataFrame:
    """(example_id, metric, value) of exact match, BLEU, GLEU and SARI. rows: example_id, src, ref, pred."""
    one = lambda df, name, column: df.select("example_id", F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))
    per = metrics.overlap_stats(rows)
    bleu = metrics.sentence_bleu(per).join(metrics.sentence_gleu(per), "example_id")
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).cast("double").alias("value")) for n, c in (("BLEU", "bleu_method2_higher_orders"), ("GLEU", "gleu"))]))
    exact = rows.select("example_id", (F.col("ref") == F.col("pred")).cast("int").alias("x"))
    sari = metrics.sari(rows.select("example_id", "src", "pred", F.array("ref").alias("refs")))
    return bleu.select("example_id", named.alias("m")).select("example_id", "m.*").unionByName(one(exact, "Acc-top-1", "x")).unionByName(one(sari, "SARI", "sari"))


def evaluate_after_rerank(best: DataFrame, rows: DataFrame, comment: bool = False, code: DataFrame | None = None) -> DataFrame:
    """evaluation_summary of the reranked predictions. best: example_id, rerank_pred; rows: example_id, src, ref."""
    chosen = rows.select("example_id", "src", "ref").join(best.select("example_id", T.normalize_ws(F.col("rerank_pred")).alias("pred")), "example_id")
    return metrics.evaluation_summary(chosen, comment, code)


def merge_and_evaluate(shards: DataFrame, rows: DataFrame, comment: bool = False) -> DataFrame:
    """evaluation_summary of predictions that come in shards. shards: id, data, rank; rows: example_id, src, ref."""
    merged = rerank.merge_prediction_shards(shards).select(F.col("id").alias("example_id"), F.col("data").alias("pred"))
    return metrics.evaluation_summary(rows.select("example_id", "src", "ref").join(merged, "example_id"), comment)


def inspect_outputs(rows: DataFrame) -> DataFrame:
    """Texts beside their scores, and whether the prediction is the source. rows: example_id, src, ref, pred."""
    stats = metrics.overlap_stats(rows)
    scores = metrics.sentence_gleu(stats).join(metrics.sentence_bleu(stats), "example_id")
    return rows.select("example_id", "src", "ref", "pred", (F.col("pred") == F.col("src")).alias("no_changes")).join(scores, "example_id")


def inspect_rerank(beams: DataFrame, best: DataFrame, refs: DataFrame) -> DataFrame:
    """(example_id, ref, base_pred, rerank_pred, changed, helped): the first candidate, not the best-scored one, beside
    the reranked one; helped: 1 if only the latter is the reference, -1 if only the former, else 0.

    beams: example_id, beam_rank, pred; best: example_id, rerank_pred; refs: example_id, ref.
    """
    base = beams.where(F.col("beam_rank") == 0).select("example_id", F.col("pred").alias("base_pred"))
    rows = refs.join(base, "example_id").join(best.select("example_id", "rerank_pred"), "example_id")
    hit = lambda c: (F.col(c) == F.col("ref")).cast("int")
    return rows.select("example_id", "ref", "base_pred", "rerank_pred", (F.col("base_pred") != F.col("rerank_pred")).alias("changed"), (hit("rerank_pred") - hit("base_pred")).alias("helped"))


def plan_side(plan: Column, side: str) -> Column:
    """The tokens of a code plan's "old" or "new" side: what stands behind the markers that belong to it."""
    mine = {"old": ("<KEEP>", "<DELETE>", "<REPLACE_OLD>"), "new": ("<KEEP>", "<INSERT>", "<REPLACE_NEW>")}[side]
    any_of = lambda marks: "|".join(re.escape(m) for m in marks)
    glue = "\u0001"
    # The plan as one text, cut before each marker: it is gone through once, however long it is.
    parts = F.split(F.concat(F.lit(glue), F.array_join(plan, glue), F.lit(glue)), f"(?={glue}(?:{any_of(T.EDIT_TOKENS)}){glue})")
    own = F.filter(parts, lambda p: p.rlike(f"^{glue}(?:{any_of(mine)})(?:{glue}|$)"))
    return F.filter(F.flatten(F.transform(own, lambda p: F.split(F.regexp_replace(p, f"^{glue}[^{glue}]*", ""), glue))), lambda w: w != "")
