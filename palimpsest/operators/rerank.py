"""Reranking of k-best candidates: base score plus a second score, ties to the earlier rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import normalize_ws, remove_keep_span, remove_tag_string, render_edit_target, render_model_input, replace_unknown, tokens
from palimpsest.operators.plans import edit_plan
from palimpsest.sources.lines import merge_gap_check
from palimpsest.sources.shared import small_batches


def rerank_best(beams: DataFrame, scores: DataFrame) -> DataFrame:
    """(example_id, top1, rerank_pred, rerank_rank): the best by base score, and by the sum of both.

    beams: example_id, beam_rank, pred, base_score; scores: example_id, beam_rank, second_score. One shuffle on the
    example serves the join and the grouping.
    """
    both = beams.join(scores, ["example_id", "beam_rank"])
    merged = F.col("base_score") + F.col("second_score")
    return both.groupBy("example_id").agg(
        F.max_by("pred", F.struct("base_score", -F.col("beam_rank"))).alias("top1"),
        F.max_by("pred", F.struct(merged, -F.col("beam_rank"))).alias("rerank_pred"),
        F.max_by("beam_rank", F.struct(merged, -F.col("beam_rank"))).alias("rerank_rank"),
    )


def rerank_hits(beams: DataFrame, best: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: examples, and how many have the reference as top-1, as reranked, or among all candidates."""
    any_of = beams.join(refs, "example_id").groupBy("example_id").agg(F.bool_or(F.col("pred") == F.col("ref")).alias("any_hit"))
    own = best.join(refs, "example_id").join(any_of, "example_id")
    hit = lambda c: F.sum(c.cast("int"))
    return own.agg(
        F.count("*").alias("examples"), hit(F.col("top1") == F.col("ref")).alias("top1_hits"),
        hit(F.col("rerank_pred") == F.col("ref")).alias("rerank_hits"), hit(F.col("any_hit")).alias("any_hits"),
    )


def collect_beams(beams: DataFrame) -> DataFrame:
    """(example_id, beams): the candidates of an example in rank order, a bounded k of them."""
    return beams.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("beam_rank", "pred"))).alias("b")).select(
        "example_id", F.array_join(F.transform("b", lambda x: x["pred"]), "\n").alias("beams"), F.size("b").alias("k")
    )


def keep_beams(beams: DataFrame, k: int = 20, exact: bool = True) -> DataFrame:
    """The first k candidates of each example; with exact, an example with fewer, or a rank twice, is an error."""
    kept = beams.where(F.col("beam_rank") < k)
    if exact:
        bad = kept.groupBy("example_id").agg(F.count("*").alias("n"), F.countDistinct("beam_rank").alias("d")).where((F.col("n") != k) | (F.col("d") != k))
        if rows := bad.limit(5).collect():
            raise ValueError(f"not {k} candidates: {[(r.example_id, r.n) for r in rows]}")
    return kept


def merge_prediction_shards(shards: DataFrame, gapless: bool = False) -> DataFrame:
    """(id, data): of each id the data of the latest shard. shards: id, data, rank. With gapless, ids that are not 0 to
    n - 1 are an error."""
    if gapless and not (row := merge_gap_check(shards).first()).gapless:
        raise ValueError(f"{row.ids} ids with gaps")
    return shards.groupBy("id").agg(F.max_by("data", "rank").alias("data"))


def prepare_rerank(beams: DataFrame, examples: DataFrame, with_plan: bool, comment: bool = False) -> DataFrame:
    """Adds full_src (the scorer's input) and seq_to_score to every candidate: the candidate itself, or behind the edit
    plan, without kept runs, that leads to it from its source. Comments lose their tags first.

    beams: example_id, beam_rank, pred, base_score; examples: example_id, src, ref, ctx.
    """
    strip = (lambda c: remove_tag_string(normalize_ws(F.col(c)))) if comment else F.col
    own = examples.select("example_id", *[strip(c).alias(c) for c in ("src", "ref")], "ctx")
    rows = beams.withColumn("pred", strip("pred")).join(own, "example_id").withColumn("full_src", render_model_input(F.col("src"), F.col("ctx")))
    if not with_plan:
        return rows.withColumn("seq_to_score", F.col("pred"))
    plan = edit_plan("code", tokens(F.replace("src", F.lit("</s>"), F.lit(""))), tokens(F.col("pred")))
    return rows.withColumn("seq_to_score", render_edit_target(remove_keep_span(F.array_join(plan, " ")), F.col("pred")))


def score_candidates(candidates: DataFrame, make_scorer: Callable[[], Callable[[pd.Series, pd.Series], pd.Series]]) -> DataFrame:
    """(example_id, beam_rank, hyp, second_score): the supplied scorer's values, better ones higher.

    candidates: example_id, beam_rank, full_src, seq_to_score. make_scorer runs once in each task and gives a function
    of inputs and outputs, a batch at a time; its contract is the negative mean loss of the output's tokens.
    """
    small_batches(candidates.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for b in batches:
            yield pd.DataFrame({"example_id": b["example_id"], "beam_rank": b["beam_rank"], "hyp": b["seq_to_score"], "second_score": scorer(b["full_src"], b["seq_to_score"])})

    return candidates.select("example_id", "beam_rank", "full_src", "seq_to_score").mapInPandas(run, "example_id long, beam_rank int, hyp string, second_score double")


def unmatched_scores(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """One row: candidates without a score, scores without a candidate, and scores of another text."""
    both = candidates.select("example_id", "beam_rank", "seq_to_score", F.lit(True).alias("c")).join(scores.select("example_id", "beam_rank", "hyp", F.lit(True).alias("s")), ["example_id", "beam_rank"], "full")
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0)).cast("long")
    other = F.col("c").isNotNull() & F.col("s").isNotNull() & ~F.col("seq_to_score").eqNullSafe(F.col("hyp"))
    return both.agg(n(F.col("s").isNull()).alias("unscored"), n(F.col("c").isNull()).alias("unknown"), n(other).alias("other_text"))


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(example_id, top1, rerank_pred, rerank_rank, scored_text): rerank_best, with the scored text of the winner."""
    best = rerank_best(candidates.select("example_id", "beam_rank", "pred", "base_score"), scores.select("example_id", "beam_rank", "second_score"))
    text = candidates.select("example_id", F.col("beam_rank").alias("rerank_rank"), replace_unknown(F.col("seq_to_score")).alias("scored_text"))
    return best.join(text, ["example_id", "rerank_rank"])
