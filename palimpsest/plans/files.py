"""Registered queries that write line, beam, record and split files and read them again, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import pipelines, states, table_functions
from palimpsest.plans import more, queries as Q
from palimpsest.sources import lines, records
from palimpsest.sources import views as V
from palimpsest.sources.shared import new_folder


def q_parallel_lines(spark, d):
    """Turn pairs as line-aligned files, in the order of their ids, and back with the numbers of their lines."""
    at = new_folder(spark)
    paths = {c: f"{at}/{c}" for c in ("id", "source", "target")}
    lines.write_parallel_lines(Q.pairs(spark, d).select(F.col("example_id").alias("line_no"), F.col("example_id").alias("id"), "source", "target"), paths)
    return lines.read_parallel_lines(spark, paths).withColumn("id", F.col("id").cast("long"))


def q_beam_lines(spark, d):
    """Candidates as k lines an example, aligned again with their references."""
    at, p = new_folder(spark), Q.pairs(spark, d)
    lines.write_beam_lines(V.candidates(p), f"{at}/hyp")
    lines.write_parallel_lines(p.select(F.col("example_id").alias("line_no"), F.col("target").alias("ref")), {"ref": f"{at}/ref"})
    return lines.align_eval(spark, {"ref": f"{at}/ref"}, f"{at}/hyp", V.BEAMS)


def q_beam_json(spark, d):
    at = new_folder(spark)
    examples = V.eval_rows(spark, d).select("example_id", "src", "ref", F.col("src").alias("full_src"), F.col("ref").alias("full_ref"), F.lit("none").alias("pred_edits"), F.col("pred").alias("rerank_pred"))
    beams = V.candidates(Q.pairs(spark, d)).select("example_id", "beam_rank", "pred", F.concat(F.lit("plan "), "pred").alias("seq_to_score"), "base_score")
    records.write_beam_json(beams.join(examples, "example_id"), at)
    return records.read_beam_json(spark, at)


def q_score_files(spark, d):
    at = new_folder(spark)
    records.write_scores_json(pipelines.example_scores(V.eval_rows(spark, d)), at)
    return spark.read.json(at).select("metric", "example_id", "value")


def q_summary_file(spark, d):
    at = new_folder(spark)
    lines.write_summary_json(pipelines.evaluate_after_rerank(V.eval_rows(spark, d).withColumnRenamed("pred", "rerank_pred"), V.eval_rows(spark, d)), at)
    return spark.read.json(at)


def q_split_dataset(spark, d):
    """Built examples by data set and split, numbered inside each."""
    at = new_folder(spark)
    built = pipelines.build_edit_dataset(Q.pairs(spark, d)).select("example_id", "model_input", "target")
    split = F.when(F.pmod("example_id", F.lit(10)) == 0, "test").when(F.pmod("example_id", F.lit(10)) == 1, "valid").otherwise("train")
    records.write_edit_dataset(built.withColumn("dataset", F.lit("turns")).withColumn("split", split), at)
    return spark.read.parquet(at).select("dataset", "split", "line_no", "example_id", "model_input", "target")


def q_eval_text(spark, d):
    """Texts as an outside scorer gets them: comments by their sub-tokens, from and to line files."""
    at = new_folder(spark)
    paths = {c: f"{at}/{c}" for c in ("src", "ref", "pred")}
    rows = V.eval_rows(spark, d).select(F.lit("x-comment-update").alias("dataset"), F.col("example_id").alias("line_no"), "src", "ref", T.empty_placeholder(F.col("pred")).alias("pred"))
    records.write_eval_text(rows, paths)
    return lines.read_parallel_lines(spark, paths)


def q_scorer_states(spark, d):
    """Corpus scores of states that a stream leaves behind: its files hold every example, and a third of them again."""
    at = new_folder(spark)
    rows = V.eval_rows(spark, d).select("example_id", "src", "ref", "pred")
    rows.unionByName(rows.where("example_id % 3 = 0")).repartition(6).write.parquet(f"{at}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/rows")
    states.keep_up(stream, f"{at}/kept", f"{at}/offsets", availableNow=True).awaitTermination()
    return states.state_scores(states.merge_states(states.read_states(spark, f"{at}/kept")))


def q_sql_scores(spark, d):
    """Candidates scored from SQL, an example's group at a time, by the share of the reference's tokens that they have; and
    how many tokens each has, by a table function."""
    def shares():
        def share(refs, preds):
            words = [set(filter(None, x.split(" "))) for x in refs]
            return refs.__class__([len(w & set(p.split(" "))) / len(w) if w else 0.0 for w, p in zip(words, preds, strict=True)])

        return share

    table_functions.register_scorer(spark, "group_scores", shares)
    table_functions.register_tokens(spark)
    p = Q.pairs(spark, d)
    V.candidates(p).join(p, "example_id").createOrReplaceTempView("scored_candidates")
    return spark.sql("""
      with s as (select * from group_scores(table(select example_id, beam_rank, target as a, pred as b from scored_candidates) partition by example_id order by beam_rank)),
      t as (select example_id, beam_rank, count(*) as tokens from scored_candidates, lateral text_tokens(pred) group by all)
      select example_id, beam_rank, round(score, 6) as score, coalesce(tokens, 0) as tokens from s left join t using (example_id, beam_rank)""")


def q_bad_bytes(spark, d):
    """Documents whose files are cut inside a sign, spoilt and overlong: read as lines, and repaired."""
    at = new_folder(spark)
    # A sign without its end, a byte that none begins with, an overlong slash, and a sign that the line's end cuts.
    parts = ["61E282", "62FF63", "64C0AF65", "66F09F98"]
    rows = V.table(spark, d, "documents").where("doc_id is not null").select(F.unhex(F.lit("0A".join(parts))).alias("bad"), F.encode(F.format_string("%012d", "doc_id"), "utf-8").alias("id"))
    lines_ = rows.select(F.concat("id", F.lit(b"\n"), "bad").alias("value"))
    lines_.select(F.col("value").cast("string").alias("value")).write.text(at)
    read = spark.read.text(at).select(T.repair_utf8(F.col("value").cast("binary")).alias("line"))
    return read.groupBy(F.when(F.length("line") == 12, "number").otherwise(F.col("line")).alias("line")).agg(F.count("*").alias("n"))


_BLEU = Q._SENT_BLEU.format(Q._sql_bleu("method2_higher_orders"))
QUERIES = {
    "parallel_lines": (q_parallel_lines, f"with {V.SQL_PAIRS} select row_number() over (order by example_id) - 1 as line_no, example_id as id, source, target from pairs"),
    "beam_lines": (q_beam_lines, f"with {V.SQL_CANDIDATES} select dense_rank() over (order by example_id) - 1 as example_id, beam_rank, pred, target as ref from candidates join pairs using (example_id)"),
    "beam_json": (q_beam_json, f"with {V.SQL_EVAL} select example_id, src, ref, src as full_src, ref as full_ref, 'none' as pred_edits, evals.pred as rerank_pred, beam_rank, candidates.pred, 'plan ' || candidates.pred as seq_to_score, base_score from candidates join evals using (example_id)"),
    "score_files": (q_score_files, f"""with {Q.SQL_STATS}, g as ({Q._SENT_GLEU}), b as ({_BLEU}), s as (with {Q._SARI}) select 'GLEU' as metric, example_id, gleu as value from g union all select 'BLEU', * from b
union all select 'SARI', example_id, sari from s union all select 'Acc-top-1', example_id, (ref = pred)::int::double from evals"""),
    "summary_file": (q_summary_file, more._summary(V.SQL_EVAL)),
    "split_dataset": (q_split_dataset, f"""with {V.SQL_PAIRS}, s as (select *, case (example_id % 10 + 10) % 10 when 0 then 'test' when 1 then 'valid' else 'train' end as split from pairs)
select 'turns' as dataset, split, row_number() over (partition by split order by example_id) - 1 as line_no, example_id, source || ' </s> ' || context as model_input, target from s"""),
    "scorer_states": (q_scorer_states, f"""with {Q.SQL_STATS}, b as (select n, sum(num) as num, sum(greatest(den, 1)) as den, sum(hlen) as hlen, sum(rlen) as rlen, count(*) as examples from per group by n),
x as (select any_value(examples) as examples, round(case when max(case when n = 1 then num end) = 0 then 0.0 else any_value({Q._BP}) * exp(avg(ln(case when num = 0 then 0.1 / den else num / den end))) end, 6) as corpus_bleu from b),
g as (select n, sum(greatest(num - pen, 0)) as num, sum(den) as den, sum(hlen) as hlen, sum(rlen) as rlen from per group by n),
y as (select round(case when min(least(num, den, hlen, rlen)) = 0 then 0.0 else exp(least(0.0, 1 - any_value(rlen) / any_value(hlen)) + avg(ln(num / den))) end, 6) as corpus_gleu from g)
select examples, corpus_bleu, corpus_gleu from x, y"""),
    "sql_scores": (q_sql_scores, f"""with {V.SQL_CANDIDATES}, w as (
  select c.example_id, beam_rank, list_distinct({V._TOK.format('target')}) as r, {V._TOK.format('pred')} as p from candidates c join pairs using (example_id))
select example_id, beam_rank, round(case when len(r) = 0 then 0.0 else len(list_intersect(r, p)) / len(r)::double end, 6) as score, len(p)::bigint as tokens from w"""),
    "bad_bytes": (q_bad_bytes, """select line, count(*) as n from (select unnest(['number', 'a' || chr(65533), 'b' || chr(65533) || 'c', 'd' || chr(65533) || chr(65533) || 'e', 'f' || chr(65533)]) as line
from documents where doc_id is not null) group by line"""),
    "eval_text": (q_eval_text, f"with {V.SQL_EVAL} select row_number() over (order by example_id) - 1 as line_no, {Q._sql_subtokens('src')} as src, {Q._sql_subtokens('ref')} as ref, {Q._sql_subtokens('pred')} as pred from evals"),
}
